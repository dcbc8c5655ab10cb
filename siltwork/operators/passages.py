"""Passages of relevant documents: diverse by TF-IDF, or random."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltwork.functions.text import chunks, sentences
from siltwork.session import stored

#: A passage this close to all selected ones is a copy of them.
SAME = 1e-12
#: Tokens and passages of a query that one task may hold: some 60 MB of strings and arrays.
IN_TASK = 500_000


def relevant(qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, doc_id, pos)`` of the rows with relevance other than 0, for the queries given."""
    return qrels.where("rel <> 0").join(queries.select("query_id"), "query_id", "left_semi").select("query_id", "doc_id", "pos")


def candidates(rel: DataFrame, docs: DataFrame, size: int = 3) -> DataFrame:
    """``(query_id, pos, chunk, passage)``: the passages of each relevant document, in the order of the judgements."""
    cut = docs.select("doc_id", F.posexplode(chunks(F.coalesce("text", F.lit("")), size)).alias("chunk", "passage"))
    return rel.join(cut, "doc_id").select("query_id", "pos", "chunk", "passage")


def _selected(tokens: list[np.ndarray], n: int) -> list[int]:
    """Places of the passages selected among those of one query, by their tokens in the order of the passages."""
    rows = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    codes, terms = pd.factorize(np.concatenate(tokens).astype(object)) if len(rows) else (np.zeros(0, int), [])
    cells, tf = np.unique(rows * max(1, len(terms)) + codes, return_counts=True)
    row, term = cells // max(1, len(terms)), cells % max(1, len(terms))
    df = np.bincount(term, minlength=len(terms))
    w = tf * (np.log((1.0 + len(tokens)) / (1.0 + df[term])) + 1.0)
    w = w / np.sqrt(np.bincount(row, weights=w * w, minlength=len(tokens)))[row] if len(row) else w
    begin = np.searchsorted(row, np.arange(len(tokens) + 1))
    chosen, sums = [0], np.zeros(len(tokens))
    open_ = np.full(len(tokens), len(rows) > 0)  # a passage without a token is like nothing; a query without any goes no further
    open_[0] = False
    for step in range(1, n):
        at = slice(begin[chosen[-1]], begin[chosen[-1] + 1])
        vector = np.zeros(len(terms))
        vector[term[at]] = w[at]
        sums += np.bincount(row, weights=w * vector[term], minlength=len(tokens))
        mean = np.round(sums / step, 12)
        fits = open_ & (mean < 1.0 - SAME)
        if not fits.any():
            break
        chosen.append(int(np.flatnonzero(fits & (mean == mean[fits].min()))[0]))
        open_[chosen[-1]] = False
    return chosen


def diverse(found: DataFrame, n: int = 5, in_task: int = IN_TASK) -> DataFrame:
    """``(query_id, step, pos, chunk, passage)``: up to ``n`` passages of each query, each least like those before it.

    The first passage comes first; then always the one with the least mean cosine to the selected ones, the first of
    equals; none that equals them all. A query with at most ``n`` passages keeps them all, in order. A query of at most
    ``in_task`` tokens and passages is selected in one task; all larger ones go step by step through joins that hold no
    query together.
    """
    keys = ["query_id", "pos", "chunk"]
    tokens = F.regexp_extract_all(F.lower("passage"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    found = stored(found.withColumn("tokens", tokens), "passages")
    size = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens") + 1).alias("n_tokens"))
    sized = found.join(size, "query_id")
    # at most n rows of a query: their order is counted within the query
    few = sized.where(F.col("n") <= n).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk"))).alias("p"))
    picks = few.select("query_id", F.posexplode("p").alias("step", "x")).select("query_id", "step", "x.*")

    def select(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pos", "chunk"], kind="stable", ignore_index=True)
        chosen = group.iloc[_selected(list(group["tokens"]), n)]
        return pd.DataFrame({"query_id": chosen["query_id"], "step": np.arange(len(chosen), dtype=np.int32), "pos": chosen["pos"], "chunk": chosen["chunk"]})

    types = {f.name: f.dataType.simpleString() for f in found.schema}
    schema = f"query_id {types['query_id']}, step int, pos {types['pos']}, chunk {types['chunk']}"
    small = sized.where((F.col("n") > n) & (F.col("n_tokens") <= in_task))
    picks = picks.unionByName(small.select(*keys, "tokens").groupBy("query_id").applyInPandas(select, schema))
    large = stored(sized.where((F.col("n") > n) & (F.col("n_tokens") > in_task)).select(*keys, "n", "tokens"), "large")
    if not large.isEmpty():
        picks = picks.unionByName(_by_steps(large, n))
    return picks.join(found.select(*keys, "passage"), keys).select("query_id", "step", "pos", "chunk", "passage")


def _by_steps(many: DataFrame, n: int) -> DataFrame:
    """``(query_id, step, pos, chunk)`` for queries of any size: a step joins the vectors of the passages just selected
    (one per query) with all vectors on query and term and adds to the running sums."""
    key = ["query_id", "pos", "chunk"]
    tf = stored(many.select(*key, "n", F.explode("tokens").alias("term")).groupBy(*key, "n", "term").agg(F.count(F.lit(1)).alias("tf")), "tf")
    df = tf.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.col("tf") * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0)
    raw = tf.join(df, ["query_id", "term"]).select(*key, "term", weight.alias("w"))
    norm = raw.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = stored(raw.join(norm, key).select(*key, "term", (F.col("w") / F.col("norm")).alias("w")), "vectors")
    spoken = many.where(F.size("tokens") > 0).select("query_id").distinct()
    sums = many.join(spoken, "query_id", "left_semi").select(*key, F.lit(0.0).alias("sim"))
    chosen = many.groupBy("query_id").agg(F.min(F.struct("pos", "chunk")).alias("p")).select("query_id", F.lit(0).alias("step"), "p.pos", "p.chunk")
    picks = [stored(chosen, "picks")]
    for step in range(1, n):
        last = picks[-1]
        # one vector a query, written, so that its true size decides how it meets the others
        vector = stored(unit.join(last.select(*key), key).select("query_id", "term", F.col("w").alias("v")), "vector")
        dots = unit.join(vector, ["query_id", "term"]).groupBy(*key).agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
        rest = sums.join(last.select(*key), key, "left_anti")
        sums = stored(rest.join(dots, key, "left").select(*key, (F.col("sim") + F.coalesce("dot", F.lit(0.0))).alias("sim")), "similarities")
        mean = F.round(F.col("sim") / step, 12)
        best = sums.where(mean < 1.0 - SAME).groupBy("query_id").agg(F.min(F.struct(mean.alias("m"), "pos", "chunk")).alias("p"))
        going = best.join(last.select("query_id"), "query_id", "left_semi")
        picks.append(stored(going.select("query_id", F.lit(step).alias("step"), "p.pos", "p.chunk"), "picks"))
    selected = picks[0]
    for p in picks[1:]:
        selected = selected.unionByName(p)
    return selected


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *parts))


def random_passages(rel: DataFrame, docs: DataFrame, n: int = 5, size: int = 4, seed: str = "0") -> DataFrame:
    """``(query_id, draw, doc_id, passage)``: ``n`` draws of a document with replacement and of a window of ``size`` sentences.

    A draw takes the document with the least hash of seed, query, draw and document: a minimum, partial before its
    shuffle. Empty passages are dropped.
    """
    draw = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")
    h = _hash(F.lit(seed), F.col("query_id"), F.col("draw").cast("string"), F.col("doc_id"))
    drawn = rel.select("query_id", "doc_id", draw).groupBy("query_id", "draw").agg(F.min(F.struct(h.alias("h"), "doc_id")).alias("x")).select("query_id", "draw", "x.doc_id")
    at = F.conv(F.substring(_hash(F.lit(seed), F.lit("start"), F.col("query_id"), F.col("draw").cast("string")), 1, 8), 16, 10).cast("long")
    s = sentences(F.coalesce("text", F.lit("")))
    window = F.array_join(F.slice(s, (at % F.size(s)).cast("int") + 1, size), ". ")
    return drawn.join(docs, "doc_id").select("query_id", "draw", "doc_id", window.alias("passage")).where("passage <> ''")
