"""Text formats read under explicit schemas. Nothing is inferred; rows that do not fit are skipped as stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.operators.ordering import with_place

CORPUS = "doc_id string, title string, abstract string"
QUERIES = "query_id string, title string, description string, narrative string"
#: Order of the columns of judgements: the plain one, and that of evaluation tools.
QRELS_ORDER = ("query_id", "doc_id", "rel", "extra")
QRELS_TREC = ("query_id", "extra", "doc_id", "rel")


def json_lines(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """One object per line with a real JSON parse: other keys, numbers and escapes are no problem.

    ``line`` keeps the raw line; ``pos`` grows within a file with the order of lines.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
    return lines.withColumn("o", F.from_json("line", schema)).select("pos", "line", "o.*")


def field(line, name: str):
    """One value of a JSON line in lower case, null if it is missing."""
    return F.lower(F.get_json_object(line, f"$.{name}"))


def _split(spark: SparkSession, path: str, pattern: str, limit: int = -1) -> DataFrame:
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.split(F.trim("value"), pattern, limit).alias("f"))


def docs_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, doc_id, url, title, text)``: lines with exactly four fields after outer white space is removed, others skipped."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\t").alias("f"))
    return lines.where(F.size("f") == 4).select("pos", *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(("doc_id", "url", "title", "text"))])


def id_text_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, doc_id, text)`` split at the first tab; lines without one have a null text."""
    lines = _split(spark, path, "\t", 2)
    return lines.select("pos", F.get("f", F.lit(0)).alias("doc_id"), F.get("f", F.lit(1)).alias("text"))


def queries_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, query_id, query)``."""
    return id_text_tsv(spark, path).toDF("pos", "query_id", "query")


def qrels(spark: SparkSession, path: str, order: tuple[str, ...] = QRELS_ORDER) -> DataFrame:
    """``(pos, query_id, doc_id, rel)`` of columns between white space."""
    lines = _split(spark, path, r"\s+").where(F.size("f") >= 3)
    cols = {c: F.get("f", F.lit(i)) for i, c in enumerate(order)}
    return lines.select("pos", cols["query_id"].alias("query_id"), cols["doc_id"].alias("doc_id"), F.try_to_number(cols["rel"], F.lit("S9999999")).cast("int").alias("rel"))


def top_docs(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, query_id, doc_id)`` of a candidate list in file order."""
    return _split(spark, path, "\t").select("pos", F.get("f", F.lit(0)).alias("query_id"), F.get("f", F.lit(1)).alias("doc_id"))


def examples(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, query, passage)``."""
    return id_text_tsv(spark, path).toDF("pos", "query", "passage")


def generated(spark: SparkSession, path: str, shots: int = 5) -> DataFrame:
    """``(pos, query_id, k, query, prompt, passage)``. In lines of five fields the number of shots is one of them; lines of
    four have none, and among these it follows from their place, which starts again after ``shots`` lines."""
    names = ("query_id", "k", "query", "prompt", "passage")
    lines = _split(spark, path, "\t")
    fields = lambda names: [F.get("f", F.lit(i)).alias(c) for i, c in enumerate(names)]
    plain = lines.where(F.size("f") == len(names)).select("pos", *fields(names))
    strided = with_place(lines.where(F.size("f") == len(names) - 1).select("pos", *fields([c for c in names if c != "k"])), ["pos"])
    strided = strided.withColumn("k", (F.col("place") % shots).cast("string")).drop("place")
    return plain.unionByName(strided).withColumn("k", F.col("k").cast("int"))


def rejected_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``(n_lines, n_rejected)``: how many lines ``docs_tsv`` reads, and how many of them it skips."""
    lines = spark.read.text(path).select((F.size(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\t")) != 4).cast("long").alias("bad"))
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_rejected"))


def lemma_table(spark: SparkSession, path: str) -> DataFrame:
    """``(token, lemma)`` of lines with a word and its base form, the first of each word."""
    rows = id_text_tsv(spark, path).toDF("pos", "token", "lemma").where("lemma is not null")
    return rows.groupBy(F.lower("token").alias("token")).agg(F.min_by("lemma", "pos").alias("lemma"))


def run_file(spark: SparkSession, path: str) -> DataFrame:
    """``(query_id, iter, doc_id, score)``."""
    return spark.read.csv(path, sep="\t", schema="query_id string, iter int, doc_id string, score double", quote="")
