"""Per-key results where a few keys hold most records (problem 7).

Nothing here gathers the rows of a key. Sums are partially aggregated on the map side, and order statistics come from
distributed exact selection: histograms of a value range are counted (counts of parts add up), the buckets that hold
the wanted ranks are kept, and only their rows are counted again with narrower buckets until the ranks are resolved.

Heavy keys are quantiles too: in the order of their hashes, a key with a share of all pairs covers at least one of the
ranks that lie that share apart, so the quantiles at these ranks name every heavy key, and no more keys than ranks.

Edge cases: rows with a null in either key are left out everywhere; null values count as rows but add nothing to sums
and take no part in quantiles; an empty table gives no rows; repeated rows count as rows once each and as one pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltwork.session import stored
from siltwork.sources.tables import id_key

#: Share of all distinct pairs, as a fraction of integers, from which a key is called heavy.
HEAVY = (2, 100)
#: Bits by which each pass of the selection narrows the range: a pass has at most so many buckets of a kept range.
STEP_BITS = 16


def pairs_of(postings: DataFrame) -> DataFrame:
    """Distinct ``(term_id, doc_key)`` with their number of rows and summed ``tf``; balanced, as the pair is the key."""
    keyed = postings.select("term_id", id_key("doc_id").alias("doc_key"), F.col("tf").cast("long").alias("tf"))
    return (
        keyed.where(F.col("term_id").isNotNull() & F.col("doc_key").isNotNull())
        .groupBy("term_id", "doc_key")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("tf").alias("tf"))
    )


def both_sides(extra: list[str]) -> Column:
    """One entry for the term and one for the document of a pair."""

    def side(field: str, value: Column) -> Column:
        return F.struct(F.lit(field).alias("key_field"), value.alias("key_value"), *extra)

    return F.explode(F.array(side("term_id", F.col("term_id").cast("string")), side("doc_id", F.col("doc_key")))).alias("s")


def totals(pairs: DataFrame) -> DataFrame:
    """``(key_field, key_value, n_rows, n_partners, total_tf)`` of every key. ``total_tf`` is null if all its tf are."""
    return (
        pairs.select(both_sides(["n_rows", "tf"]))
        .select("s.*")
        .groupBy("key_field", "key_value")
        .agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_partners"), F.sum("tf").alias("total_tf"))
    )


def _ordered(value: Column) -> Column:
    """A long such that unsigned comparison of its bits is the order of ``value``: the sign bit turned over."""
    return value.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _bucket(ordered: str, bits: int) -> Column:
    """The first ``bits`` bits of a value of 64, as a number that keeps their order."""
    return F.shiftrightunsigned(ordered, 64 - bits) if bits < 64 else F.col(ordered).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def heavy_keys(pairs: DataFrame, share: tuple[int, int] = HEAVY) -> DataFrame:
    """``(key_field, key_value, n_partners)`` of the keys with at least ``share`` of all pairs.

    Exact selection of the ranks that are multiples of ``ceil(n * share)`` over the range of 64-bit key hashes: a pass counts the buckets of the ranges kept, a running sum over the at most
    ``2 ** STEP_BITS`` buckets of a range finds those that hold a wanted rank, at most ``1 / share`` of them come to
    the driver, and the next pass counts only their rows. A bucket is resolved once its least and greatest hash agree.
    The keys of the resolved hashes are then counted themselves, which settles hashes that two keys share.
    """
    num, den = share
    if not 0 < num <= den:
        raise ValueError("share must be between 0 and 1")
    kept = stored(pairs.select("term_id", "doc_key"), "pairs")
    n = kept.count()
    apart = max(1, -(-n * num // den))
    values = {"term_id": F.col("term_id").cast("string"), "doc_id": F.col("doc_key")}
    hashes = {"term_id": F.xxhash64(F.col("term_id")), "doc_id": F.xxhash64(F.col("doc_key"))}
    found = []
    for field, value in values.items():
        # ranges kept: their prefix, and how many pairs lie before them
        done, ranges, bits = [], {0: 0}, 0
        while ranges:
            rows = kept.select(hashes[field].alias("h")).select("h", _ordered(F.col("h")).alias("o"))
            prefix = _bucket("o", bits) if bits else F.lit(0).cast("long")
            rows = rows.where(prefix.isin(list(ranges))) if bits else rows
            bits += STEP_BITS
            counts = rows.groupBy(prefix.alias("prefix"), _bucket("o", bits).alias("bucket")).agg(F.count(F.lit(1)).alias("c"), F.min("h").alias("lo"), F.max("h").alias("hi"))
            upto = Window.partitionBy("prefix").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            before = F.create_map(*[F.lit(x).cast("long") for pair in ranges.items() for x in pair])
            placed = counts.withColumn("upto", F.sum("c").over(upto) + F.element_at(before, F.col("prefix")))
            holds = F.floor(F.col("upto") / apart) > F.floor((F.col("upto") - F.col("c")) / apart)
            hit = placed.where(holds).select("bucket", "lo", "hi", (F.col("upto") - F.col("c")).alias("before")).collect()
            done += [r["lo"] for r in hit if r["lo"] == r["hi"]]
            ranges = {r["bucket"]: r["before"] for r in hit if r["lo"] != r["hi"]}
        found.append(kept.where(hashes[field].isin(done)).select(F.lit(field).alias("key_field"), value.alias("key_value")))
    return (
        found[0]
        .unionByName(found[1])
        .groupBy("key_field", "key_value")
        .agg(F.count(F.lit(1)).alias("n_partners"))
        .where(F.col("n_partners") * den >= F.lit(n) * num)
    )


def key_quantiles(rows: DataFrame, key: list[str], value: str, quantiles: list[float]) -> DataFrame:
    """Exact lower quantiles of a column of whole numbers per key: ``(*key, quantile, n, value)``.

    The value of rank ``greatest(1, ceil(q n))`` in ascending order, of any type from tinyint to bigint; other types are
    refused. Rows are first reduced to counts per key and value; then four passes narrow the range by ``STEP_BITS``
    each: counts per key and bucket, a running sum over the buckets of a key and quantile, the bucket that reaches the
    rank. A pass reads only values of the buckets kept by the one before. No pass holds a key's rows together.
    """
    kind = rows.schema[value].dataType
    if kind.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"quantiles of {value}: {kind.simpleString()} is no type of whole numbers")
    # the caller's names come back at the end, so they cannot clash with the names used here
    counts = stored(
        rows.where(F.col(value).isNotNull())
        .groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], _ordered(F.col(value)).alias("v"))
        .agg(F.count(F.lit(1)).alias("c")),
        "value-counts",
    )
    keys = [f"_k{i}" for i in range(len(key))]
    per_key = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    state = per_key.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    state = state.withColumn("rank", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("quantile") * F.col("n"))))
    by = list(keys)
    for bits in range(STEP_BITS, 65, STEP_BITS):
        rest = counts
        if bits > STEP_BITS:
            prefix = _bucket("v", bits - STEP_BITS).alias("prefix")
            rest = counts.select(*keys, "v", "c", prefix).join(state.select(*by).distinct(), by, "left_semi")
        bucketed = rest.groupBy(*by, _bucket("v", bits).alias("b")).agg(F.sum("c").alias("c"))
        hit = bucketed.join(state, by)
        upto = Window.partitionBy(*keys, "quantile").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hit = hit.withColumn("upto", F.sum("c").over(upto))
        state = hit.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank"))).select(
            *keys, "quantile", "n", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.col("b").alias("prefix")
        )
        by = [*keys, "prefix"]
    return state.select(*[F.col(k).alias(name) for k, name in zip(keys, key, strict=True)], "quantile", "n", F.col("prefix").cast(kind).alias("value"))
