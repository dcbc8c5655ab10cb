"""Inverted index: term frequencies, postings, document frequencies and norms.

Frequencies of documents that are already distributed by their id are counted without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions.text import analyze, idf_weight, tf_weight
from siltwork.operators.ordering import with_place
from siltwork.session import stored


def term_frequencies(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """``(term, doc_id, tf)`` of ``(doc_id, text)``; a map-side sum goes before the shuffle."""
    tokens = analyze(F.col("text")) if tokens is None else tokens
    return docs.select("doc_id", F.explode(tokens).alias("term")).groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def document_norms(tf: DataFrame) -> DataFrame:
    """``(doc_id, norm)``: root of the summed squares of tf weights."""
    w = tf_weight(F.col("tf"))
    return tf.groupBy("doc_id").agg(F.sqrt(F.sum(w * w)).alias("norm"))


def bags(tf: DataFrame) -> DataFrame:
    """``(doc_id, terms)``: all terms of a document with their ``tf`` in one row."""
    return tf.groupBy("doc_id").agg(F.collect_list(F.struct("term", "tf")).alias("terms"))


def postings(tf: DataFrame, per_block: int = 100_000) -> DataFrame:
    """``(term, block, df, postings)``: lists in the order of documents, in blocks of at most ``per_block`` documents.

    A term of a third of all documents would make one list of any length, so a longer list is cut: block b has its
    postings from place ``b * per_block`` on. Only terms of more than one block are put in a global order for that; the
    others are grouped in one shuffle.
    """
    entries = F.array_sort(F.collect_list(F.struct("doc_id", "tf")))
    tf = stored(tf, "tf")
    long_ = stored(document_frequencies(tf).where(F.col("df") > per_block), "long-lists")
    if long_.isEmpty():
        return tf.groupBy("term").agg(F.lit(0).cast("long").alias("block"), F.count(F.lit(1)).alias("df"), entries.alias("postings"))
    short = tf.join(long_, "term", "left_anti").groupBy("term").agg(F.lit(0).cast("long").alias("block"), F.count(F.lit(1)).alias("df"), entries.alias("postings"))
    placed = with_place(tf.join(long_, "term"), ["doc_id"], ["term"]).withColumn("block", F.floor(F.col("place") / per_block))
    return short.unionByName(placed.groupBy("term", "block").agg(F.first("df").alias("df"), entries.alias("postings")))


@dataclass
class Index:
    """Tables of an index; ``tf`` has ``(term, doc_id, tf)``, ``bags`` the same by document if it is written."""

    tf: DataFrame
    df: DataFrame
    norms: DataFrame
    n_docs: int
    bags: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, tokens: Column | None = None) -> Index:
        tf = term_frequencies(docs, tokens)
        norms = document_norms(tf)
        return cls(tf, document_frequencies(tf), norms, norms.count())

    @classmethod
    def by_document(cls, docs: DataFrame, tokens: Column | None = None) -> Index:
        """The same over terms that are counted once and written by document."""
        held = stored(bags(term_frequencies(docs, tokens)), "bags")
        tf = held.select("doc_id", F.inline("terms")).select("term", "doc_id", "tf")
        squares = F.aggregate("terms", F.lit(0.0), lambda a, t: a + tf_weight(t["tf"]) * tf_weight(t["tf"]))
        norms = held.select("doc_id", F.sqrt(squares).alias("norm"))
        return cls(tf, document_frequencies(tf), norms, norms.count(), held)

    def documents(self) -> DataFrame:
        """``bags``, written now if they are not."""
        if self.bags is None:
            self.bags = stored(bags(self.tf), "bags")
        return self.bags

    def save(self, path: str, partitions: int | None = None) -> None:
        """Postings sorted by term within partitions, so a lookup reads few row groups."""
        tf = self.tf.repartition(partitions, "term") if partitions else self.tf.repartition("term")
        tf.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/tf")
        for name, df in (("df", self.df), ("norms", self.norms)):
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        parts = {name: spark.read.parquet(f"{path}/{name}") for name in ("tf", "df", "norms")}
        return cls(parts["tf"], parts["df"], parts["norms"], parts["norms"].count())

    def idf(self) -> DataFrame:
        return self.df.select("term", "df", idf_weight(F.lit(self.n_docs), F.col("df")).alias("idf"))
