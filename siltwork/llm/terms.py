"""Frequency of every distinct term, kept up to date by signed deltas (problem 3).

The state is a folder in the shared file system. Its records lie in segments, one per load, each with the records that
load added, changed or deleted (key, hash and text); the segment that was written last has a key's present record. Its
counts lie in hash buckets of the terms. ``apply_changes`` takes changed records only: it looks up the present texts of
their keys, aggregates both sides into signed changes per term, merges these into the buckets they touch, and writes
the next version beside the last one, so a lost executor or a failed run leaves the old version whole. ``apply`` takes
a whole table and finds the changes first, by comparing hashes; texts of unchanged records are not moved.

The manifest of a version is written last and names its tables and the number of buckets; a state opened on the folder
goes on from the last version that has one, whichever session wrote it. After ``MAX_SEGMENTS`` loads the segments are
written as one.

Edge cases: records without a key are none; null and empty texts count as records without terms; very long texts are
one array at a time; a term that no record holds any more leaves the counts; an empty table gives an empty state;
deleting a record that does not exist changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.session import stored
from siltwork.sources.tables import id_key

#: Partitions of the counts of a new state, a parameter that the state keeps; a delta rewrites those it touches.
BUCKETS = 32
#: Segments of records before they are written as one.
MAX_SEGMENTS = 16
#: What separates terms, besides ASCII white space.
DELIMITERS = "[ \\t\\n\\x0b\\f\\r,.:;\"']+"
RARE_BELOW = 3
COMMON_ABOVE = (30, 100)
_MANIFEST = "buckets map<int, string>, n_buckets int, segments array<int>, n_records bigint"
_SEGMENT = "key string, hash binary, text string, deleted boolean"
_COUNTS = "term string, n_occurrences bigint, n_records bigint"


def terms_of(text: Column) -> Column:
    """Terms of a text in sorted order: non-ASCII dropped without a split, lower case, cut at the delimiters."""
    ascii_only = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x00-\x7F]", ""))
    return F.array_sort(F.filter(F.split(ascii_only, DELIMITERS), lambda x: x != ""))


def signed_counts(rows: DataFrame) -> DataFrame:
    """``(term, n_occurrences, n_records)`` summed over rows ``(text, sign)``.

    The terms of a record are sorted, so the first of each run marks it once as a record; no shuffle per record.
    """
    marked = F.transform("t", lambda x, i: F.struct(x.alias("term"), F.when((i == 0) | (F.get("t", i - 1) != x), 1).otherwise(0).alias("first")))
    return (
        rows.select("sign", terms_of(F.col("text")).alias("t"))
        .select("sign", F.explode(marked).alias("x"))
        .groupBy(F.col("x.term").alias("term"))
        .agg(F.sum("sign").alias("n_occurrences"), F.sum(F.col("sign") * F.col("x.first")).alias("n_records"))
    )


def first_records(docs: DataFrame) -> DataFrame:
    """``(key, text)``: the row with the lowest ``line_no`` of every ``doc_id``."""
    keyed = docs.where(F.col("doc_id").isNotNull()).select(id_key("doc_id").alias("key"), "line_no", "text")
    return keyed.groupBy("key").agg(F.min_by(F.struct("text"), F.col("line_no")).alias("r")).select("key", F.col("r.text").alias("text"))


def _hash(text: Column) -> Column:
    """128 bits of a text; null differs from the empty text."""
    return F.unhex(F.md5(F.concat(F.when(text.isNull(), "0").otherwise("1"), F.coalesce(text, F.lit(""))).cast("binary")))


class TermState:
    """Persistent counts in a folder; each version is complete and never changed. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder = spark, folder
        self.version = max(self._versions("/manifest/*.parquet"), default=0)
        self._paths: dict[int, str] = {}
        self._segments: list[int] = []
        self._n_records, self.n_buckets = 0, buckets
        if self.version:
            manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/v{self.version}/manifest").first()
            self._paths = {b: f"{folder}/{p}" for b, p in manifest["buckets"].items()}
            self._segments, self._n_records, self.n_buckets = list(manifest["segments"]), manifest["n_records"], manifest["n_buckets"]

    def _versions(self, holding: str = "") -> list[int]:
        """Numbers of the versions in the folder that hold such a file."""
        found = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v*{holding}")
        files = found.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(found)
        names = [str(f.getPath().toString()).split("/")[-1 - holding.count("/")] for f in files or ()]
        return [int(n[1:]) for n in names if n[1:].isdigit()]

    def _lines(self) -> DataFrame:
        """``(key, hash, text, deleted, segment)`` of all segments."""
        out = self.spark.createDataFrame([], _SEGMENT + ", segment int")
        for i, v in enumerate(self._segments):
            lines = self.spark.read.schema(_SEGMENT).parquet(f"{self.folder}/v{v}/records").withColumn("segment", F.lit(v))
            out = lines if i == 0 else out.unionByName(lines)
        return out

    def _present(self, lines: DataFrame, columns: list[str]) -> DataFrame:
        """The last line of every key, if it is no deletion. One segment has each key once."""
        if len(self._segments) > 1:
            lines = lines.groupBy("key").agg(F.max_by(F.struct(*columns, "deleted"), "segment").alias("r")).select("key", "r.*")
        return lines.where("not deleted").select("key", *columns)

    def records(self) -> DataFrame:
        """``(key, text)`` of the records counted."""
        return self._present(self._lines(), ["text"])

    def counts(self, buckets: list[int] | None = None) -> DataFrame:
        """``(term, n_occurrences, n_records)`` as of the last version."""
        paths = sorted({p for b, p in self._paths.items() if buckets is None or b in buckets})
        return self.spark.read.schema(_COUNTS).parquet(*paths) if paths else self.spark.createDataFrame([], _COUNTS)

    def n_records(self) -> int:
        return self._n_records

    def apply(self, records: DataFrame) -> TermState:
        """Make ``records`` (key, text; one row per key) the counted ones, by their difference to those before."""
        now = records.where("key is not null").select("key", "text")
        if not self._segments:
            return self.apply_changes(now.withColumn("deleted", F.lit(False)))
        now = stored(now.withColumn("new", _hash(F.col("text"))), "records")
        old = self._present(self._lines().drop("text"), ["hash"])
        both = old.join(now.select("key", "new"), "key", "full").where(~F.col("hash").eqNullSafe(F.col("new")))
        changed = stored(both.select("key", F.col("new").isNull().alias("deleted")), "changed")
        return self.apply_changes(changed.join(now.select("key", "text"), "key", "left"))

    def apply_changes(self, changes: DataFrame) -> TermState:
        """Take over ``changes`` (key, text, deleted; one row per key): records added or changed, and keys deleted."""
        version = max(self._versions(), default=0) + 1  # after those that failed runs left without a manifest
        new = f"{self.folder}/v{version}"
        lines = changes.where("key is not null").select("key", _hash(F.col("text")).alias("hash"), "text", F.col("deleted").cast("boolean").alias("deleted"))
        lines.write.parquet(f"{new}/records")
        lines = self.spark.read.schema(_SEGMENT).parquet(f"{new}/records")
        one = F.lit(1).cast("long")
        sides = lines.where("not deleted").select("text", one.alias("sign"))
        had = None
        if self._segments:
            # only the lines of changed keys go on: the changes are the small side of the join
            had = stored(self._present(self._lines().join(lines.select("key"), "key", "left_semi"), ["text"]), "before")
            sides = sides.unionByName(had.select("text", (-one).alias("sign")))
        delta = signed_counts(sides).where("n_occurrences <> 0 or n_records <> 0")
        bucket = F.pmod(F.hash("term"), F.lit(self.n_buckets))
        delta.withColumn("bucket", bucket).repartition(self.n_buckets, "bucket").write.partitionBy("bucket").parquet(f"{new}/delta")
        schema = _COUNTS + ", bucket int"
        delta = self.spark.read.schema(schema).parquet(f"{new}/delta")
        touched = sorted(r[0] for r in delta.select("bucket").distinct().collect())  # at most n_buckets rows
        place = "counts" if self._paths else "delta"
        if self._paths and touched:
            merged = self.counts(touched).unionByName(delta.drop("bucket")).groupBy("term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))
            merged.where("n_records > 0").withColumn("bucket", bucket).repartition(self.n_buckets, "bucket").write.partitionBy("bucket").parquet(f"{new}/counts")
        kept = {r[0] for r in self.spark.read.schema(schema).parquet(f"{new}/{place}").select("bucket").distinct().collect()} if touched else set()
        self._paths = {b: p for b, p in self._paths.items() if b not in touched} | {b: f"{new}/{place}/bucket={b}" for b in touched if b in kept}
        self._n_records += lines.where("not deleted").count() - (had.count() if had is not None else 0)
        self._segments, self.version = [*self._segments, version], version
        if len(self._segments) > MAX_SEGMENTS:
            self._compact()
        buckets = {b: p.removeprefix(f"{self.folder}/") for b, p in self._paths.items()}
        self.spark.createDataFrame([(buckets, self.n_buckets, self._segments, self._n_records)], _MANIFEST).coalesce(1).write.parquet(f"{new}/manifest")
        return self

    def _compact(self) -> None:
        """All records as one segment: that of a version of its own, which has no counts and no manifest."""
        version = self.version + 1
        lines = self._present(self._lines(), ["hash", "text"]).withColumn("deleted", F.lit(False))
        lines.select("key", "hash", "text", "deleted").write.parquet(f"{self.folder}/v{version}/records")
        self._segments = [version]


def marked(state: TermState) -> DataFrame:
    """``(term, n_occurrences, n_records, mark)``; ``mark`` is ``rare``, ``common`` or null."""
    n = state.n_records()
    num, den = COMMON_ABOVE
    mark = F.when(F.col("n_records") < RARE_BELOW, "rare").when(F.col("n_records") * den > F.lit(n) * num, "common")
    return state.counts().withColumn("mark", mark)
