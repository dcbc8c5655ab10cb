"""BM25 reranking of candidates and its evaluation by NDCG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltwork.operators.ordering import with_place
from siltwork.session import stored

#: Parameters of the ranking function and the cut-offs reported.
K1, B, EPSILON = 4.46, 0.82, 0.25
CUTOFFS = (5, 10, 50)


def with_relevance(candidates: DataFrame, qrels: DataFrame) -> DataFrame:
    """``candidates`` (query_id, doc_id, ...) with ``rel``, 0 where a pair is not judged."""
    joined = candidates.join(qrels.select("query_id", "doc_id", "rel"), ["query_id", "doc_id"], "left")
    return joined.withColumn("rel", F.coalesce("rel", F.lit(0)))


def bm25(candidates: DataFrame, doc_tokens: DataFrame, query_terms: DataFrame, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """``(query_id, doc_id, score)`` of every candidate that has a document; the collection is the query's candidates.

    ``doc_tokens`` has ``(doc_id, tokens)``, ``query_terms`` ``(query_id, term, qtf)``. Frequencies are counted once
    per document and then meet the candidates; all sums per query are partial before their shuffle, and only the terms of
    the query itself (a text's worth) come together. Terms in more than
    half of the candidates have the mean idf times ``epsilon``. Candidates that match nothing score 0.
    """
    sized = doc_tokens.select("doc_id", F.size("tokens").alias("dl"))
    pairs = stored(candidates.select("query_id", "doc_id").distinct().join(sized, "doc_id"), "pairs")
    stats = pairs.groupBy("query_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    tf = stored(doc_tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")), "tf")
    own = stored(query_terms.select("query_id", "term", "qtf"), "own")
    df = pairs.select("query_id", "doc_id").join(tf.select("doc_id", "term"), "doc_id").groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    idf = df.join(stats.select("query_id", "n"), "query_id").select("query_id", "term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    # the mean is over all terms of the candidates, so it is taken before only the query's own terms stay
    both = idf.join(own, ["query_id", "term"], "left")
    per_query = both.groupBy("query_id").agg((F.avg("idf") * epsilon).alias("floor"), F.collect_list(F.when(F.col("qtf").isNotNull(), F.struct("term", "qtf", "idf"))).alias("own"))
    idf = per_query.select("query_id", "floor", F.explode("own").alias("t")).select("query_id", "t.term", "t.qtf", F.when(F.col("t.idf") < 0, F.col("floor")).otherwise(F.col("t.idf")).alias("idf"))
    weights = stored(idf.join(stats.select("query_id", "avgdl"), "query_id"), "weights")
    # documents keep only terms that some query has, then meet their queries, then each query's own terms
    few = tf.join(own.select("term").distinct(), "term", "left_semi")
    matched = pairs.join(few, "doc_id").join(weights, ["query_id", "term"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = matched.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    return pairs.select("query_id", "doc_id").join(scored, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def ranked(scored: DataFrame) -> DataFrame:
    """``scored`` (query_id, doc_id, score, ...) with ``rank`` from 1 in each query: score descending, then smaller id.

    Places are counted over ranges of the order, so no query comes together in one task.
    """
    return with_place(scored.withColumn("_down", -F.col("score")), ["_down", "doc_id"], ["query_id"]).withColumn("rank", F.col("place") + 1).drop("_down", "place")


def unmatched(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """``(query_id, n_candidates, n_missing)``: how many candidates of each query have no document and are left out."""
    known = docs.select("doc_id").distinct().withColumn("_known", F.lit(1))
    joined = candidates.select("query_id", "doc_id").distinct().join(known, "doc_id", "left")
    return joined.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.count(F.when(F.col("_known").isNull(), 1)).alias("n_missing"))


def _discounts(first: Column, last: Column) -> Column:
    """Sum of 1 / log2(rank + 1) over the ranks from ``first`` to ``last``; 0 if there are none."""
    ranks = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + 1.0 / F.log2(r + 1.0))


def ndcg(ranked: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, keys: list[str] | None = None) -> DataFrame:
    """``(*keys, cutoff, ndcg)`` of ``(query_id, ..., score, rel)``: linear gain, tied scores share their mean gain.

    Rows are counted per score first; of these groups only the first ``max(cutoffs)`` of a query can matter, which the
    window's group limit applies before the shuffle, so no query comes together whole. A query without gain has 0.
    """
    keys = keys or ["query_id"]
    most = max(cutoffs)
    rounded = F.round("score", 9)

    def best(by: Column, gain: Column) -> DataFrame:
        groups = ranked.groupBy(*keys, by.alias("by")).agg(F.count(F.lit(1)).alias("c"), F.sum(gain.cast("double")).alias("g"))
        order = Window.partitionBy(*keys).orderBy(F.col("by").desc())
        first = groups.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most)
        upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        first = first.withColumn("last", F.sum("c").over(upto)).withColumn("cutoff", F.explode(F.array(*[F.lit(c) for c in cutoffs])))
        begin = F.col("last") - F.col("c") + 1
        value = F.col("g") / F.col("c") * _discounts(begin, F.least(F.col("last"), F.col("cutoff").cast("long")))
        return first.groupBy(*keys, "cutoff").agg(F.sum(value).alias("dcg"))

    ranked = stored(ranked.select(*keys, "score", "rel"), "ranked")
    real = best(rounded, F.col("rel"))
    ideal = best(F.col("rel"), F.col("rel")).withColumnRenamed("dcg", "ideal")
    return real.join(ideal, [*keys, "cutoff"]).select(*keys, "cutoff", F.when(F.col("ideal") != 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def mean_ndcg(per_query: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(*keys, cutoff, ndcg)``: the mean over queries."""
    return per_query.groupBy(*(keys or []), "cutoff").agg(F.avg("ndcg").alias("ndcg"))
