"""Text formats written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, path: str, columns: list[str], sep: str = "\t", mode: str = "overwrite") -> None:
    """Columns joined by ``sep``, one row a line; nulls become empty fields."""
    df.select(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).write.mode(mode).text(path)


def raw_lines(df: DataFrame, path: str) -> None:
    """The original lines again."""
    df.select("line").write.mode("overwrite").text(path)


def run_file(ranked: DataFrame, path: str) -> None:
    """Query, 0, document and score with six significant digits, best first within a query."""
    out = ranked.repartition("query_id").sortWithinPartitions("query_id", "rank")
    lines(out.select("query_id", F.lit("0").alias("iter"), "doc_id", F.format_string("%.6g", "score").alias("score")), path, ["query_id", "iter", "doc_id", "score"])


def passages(df: DataFrame, path: str) -> None:
    lines(df, path, ["query", "passage"])


def generated(df: DataFrame, path: str) -> None:
    """Prompts keep their line feeds as two characters."""
    lines(df.withColumn("prompt", F.replace("prompt", F.lit("\n"), F.lit("\\n"))), path, ["query_id", "k", "query", "prompt", "passage"])


def preprocessed(df: DataFrame, path: str) -> None:
    lines(df.withColumn("tokens", F.array_join("tokens", " ")), path, ["doc_id", "tokens"])


def ranking(ranked: DataFrame, path: str) -> None:
    """Query, document, rank and score with four decimals, best first within a query."""
    out = ranked.repartition("query_id").sortWithinPartitions("query_id", "rank").withColumn("score", F.format_string("%.4f", "score"))
    lines(out, path, ["query_id", "doc_id", "rank", "score"])


def report(metrics: DataFrame, path: str) -> None:
    """Metrics appended to a text report: a line per number of shots and cut-off."""
    text = F.format_string("Reranking with k=%d\tAverage NDCG@%d: %.6f", "k", "cutoff", "ndcg")
    metrics.orderBy("k", "cutoff").select(text.alias("value")).coalesce(1).write.mode("append").text(path)
