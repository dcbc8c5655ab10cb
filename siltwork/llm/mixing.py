"""Mixing sources to target weights (problem 9).

The size of a document is its number of tokens. Each source has a budget: its share of the total size of all
documents. A source that cannot reach its budget with all allowed repeats is given whole that often and reported. For
the others the budget is split into whole passes over the source and a rest smaller than one pass. The rest is fitted
as a subset sum over the counts of documents by exact token length: every length gives its proportional part, then
single documents of the largest lengths that fit while the rest is wide, and what is left below ``DP_TOKENS`` is filled
by a bounded-knapsack dynamic programme over reachable sums (one bit per sum). Seeded documents are then selected by
length count: the ``take`` smallest hashes of a (source, length). That selection counts hash buckets first, so only
the one bucket that is partly taken is ever put in order; a length with a third of all rows is spread over 256 parts.

The fit sees only the distinct lengths of one source: at most sqrt(2 x tokens) rows, as their sum is bounded.

Edge cases: null, empty and blank sources and sources without a target count in the total only; documents of zero
tokens have no size and are in no mix; targets named twice add up their shares and take the lowest repeat limit; a
null share is 0, a null or negative limit is 0; an empty table of documents gives targets without tokens.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltwork.llm.bpe import TOKENIZERS, VOCABULARY, n_tokens_of
from siltwork.session import stored
from siltwork.sources.tables import id_key

SEED = "siltwork-mix"
#: Width of the dynamic programme: reachable sums are a bit set of this many tokens.
DP_TOKENS = 1 << 16
HASH_BUCKETS = 256


def sized(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """``(doc_id, key, n_tokens)`` of every document, written to the shared folder: tokens are counted once."""
    return stored(documents.select("doc_id", id_key("source").alias("key"), n_tokens_of(F.col("text"), folder, name).alias("n_tokens")), "sizes")


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``(key, source, target_share, max_repeats, available, total, budget)``: one row per target."""
    wanted = (
        targets.where(F.col("source").isNotNull())
        .groupBy(id_key("source").alias("key"))
        .agg(
            F.min("source").alias("source"),
            F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"),
            F.greatest(F.min(F.coalesce("max_repeats", F.lit(0))), F.lit(0)).alias("max_repeats"),
        )
    )
    per_source = sizes.groupBy("key").agg(F.sum("n_tokens").cast("long").alias("available"))
    total = per_source.agg(F.sum("available")).first()[0] or 0
    joined = wanted.join(per_source, "key", "left").withColumn("total", F.lit(total).cast("long"))
    available = F.coalesce("available", F.lit(0).cast("long"))
    return joined.withColumns(
        {
            "available": available,
            "budget": F.round(F.col("target_share") * F.col("total")).cast("long"),
        }
    )


def fit(lengths: list[int], counts: list[int], rest: int, width: int = DP_TOKENS) -> list[int]:
    """How many documents of each length to take so that their tokens come to ``rest``, or as little below as found.

    Proportional parts, then greedy single documents until the rest is below ``width``; of the shortest documents as
    many are given back as the width takes, so that there is a choice; then an exact bounded knapsack. A ``rest`` below
    ``width`` is given back whole, so nothing can come closer to it.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if total <= rest:
        return list(counts)
    take = [c * rest // total for c in counts]
    left = rest - sum(n * t for n, t in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if left < width:
            break
        more = min(counts[i] - take[i], (left - width) // lengths[i] + 1, left // lengths[i])
        take[i] += max(0, more)
        left -= max(0, more) * lengths[i]
    # where the rest is still wider, every document that is not taken is longer than it
    for i in reversed(order):
        back = min(take[i], max(0, width - 1 - left) // lengths[i])
        take[i] -= back
        left += back * lengths[i]
        if back < take[i] + back:
            break
    width = min(left, width - 1)
    mask, reach, layers = (1 << (width + 1)) - 1, 1, []
    for i in order:
        spare, part = min(counts[i] - take[i], width // lengths[i]), 1
        while spare > 0 and not reach >> width & 1:  # binary parts of the spare count
            part = min(part, spare)
            layers.append((i, part, reach))
            reach |= reach << (lengths[i] * part) & mask
            spare -= part
            part *= 2
    at = reach.bit_length() - 1
    for i, part, before in reversed(layers):
        if not before >> at & 1:
            take[i] += part
            at -= lengths[i] * part
    return take


def allotted(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """``(key, n_tokens, passes, take)``: whole passes of a source, and how many documents of each length once more."""
    histogram = sizes.where(F.col("key").isNotNull() & (F.col("n_tokens") > 0)).groupBy("key", "n_tokens").agg(F.count(F.lit(1)).alias("c"))
    rows = histogram.join(F.broadcast(planned.select("key", "available", "budget", "max_repeats")), "key")

    def one_source(group: pd.DataFrame) -> pd.DataFrame:
        r = group.iloc[0]
        lengths, counts = group["n_tokens"].tolist(), group["c"].tolist()
        budget, available = int(r["budget"]), int(r["available"])
        passes = min(budget // available, int(r["max_repeats"]))
        rest = budget - passes * available if passes < r["max_repeats"] else 0
        take = fit(lengths, counts, rest) if rest else [0] * len(lengths)
        return pd.DataFrame({"key": group["key"], "n_tokens": lengths, "passes": passes, "take": take})

    return rows.groupBy("key").applyInPandas(one_source, "key string, n_tokens int, passes bigint, take bigint")


def mixed(sizes: DataFrame, planned: DataFrame, seed: str = SEED) -> DataFrame:
    """``(doc_id, source, n_tokens, copies)``: the documents of the mix and how often each is in it."""
    parts = stored(allotted(sizes, planned), "allotment")
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    docs = sizes.where(F.col("key").isNotNull() & (F.col("n_tokens") > 0)).withColumns({"h": h, "bucket": F.pmod(F.shiftrightunsigned(h, 32), F.lit(HASH_BUCKETS))})
    group = ["key", "n_tokens"]
    upto = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = (
        docs.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(upto)).join(parts, group)
        .withColumn("in_bucket", F.greatest(F.lit(0), F.least(F.col("c"), F.col("take") - F.col("upto") + F.col("c"))))
        .select(*group, "bucket", "c", "passes", "in_bucket")
    )
    chosen = docs.join(buckets, [*group, "bucket"])
    partly = (F.col("in_bucket") > 0) & (F.col("in_bucket") < F.col("c"))
    ranked = chosen.where(partly).withColumn("rn", F.row_number().over(Window.partitionBy(*group, "bucket").orderBy("h", "doc_id")))
    ranked = ranked.withColumn("once", (F.col("rn") <= F.col("in_bucket")).cast("int")).drop("rn")
    whole = chosen.where(~partly).withColumn("once", (F.col("in_bucket") > 0).cast("int"))
    names = planned.select("key", "source")
    return (
        ranked.unionByName(whole).withColumn("copies", F.col("passes") + F.col("once")).where("copies > 0")
        .join(F.broadcast(names), "key").select("doc_id", "source", "n_tokens", "copies")
    )


def report(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """One row per target: budget, tokens and share reached, passes, and whether the target can be reached."""
    parts = allotted(sizes, planned)
    counts = sizes.where(F.col("key").isNotNull() & (F.col("n_tokens") > 0)).groupBy("key", "n_tokens").agg(F.count(F.lit(1)).alias("c"))
    got = parts.join(counts, ["key", "n_tokens"]).groupBy("key").agg(
        F.sum(F.col("n_tokens") * (F.col("passes") * F.col("c") + F.col("take"))).alias("tokens"), F.max("passes").alias("passes")
    )
    tokens = F.coalesce("tokens", F.lit(0).cast("long"))
    rows = planned.join(got, "key", "left").withColumns({"tokens": tokens, "passes": F.coalesce("passes", F.lit(0).cast("long"))})
    # a target is out of reach if every allowed repeat of every document is in the mix, and its tokens are still short
    spent = F.col("tokens") == F.col("max_repeats") * F.col("available")
    rows = rows.withColumn("reachable", ~(spent & (F.col("tokens") < F.col("target_share") * F.col("total"))))
    rows = rows.withColumn("mix_tokens", F.sum("tokens").over(Window.partitionBy("total")))  # one row per target
    return rows.select(
        "source", "target_share", "max_repeats", "available", "budget", "tokens", "passes", "reachable",
        F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).alias("reached_of_total"),
        F.when(F.col("mix_tokens") > 0, F.col("tokens") / F.col("mix_tokens")).alias("share_of_mix"),
    )


def unreachable(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """``(source)``: targets whose fitted tokens stay short although the fit has used up all allowed repeats."""
    return report(sizes, planned).where(~F.col("reachable")).select("source")


