"""Few-shot examples for query expansion, prompts, and text generation."""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltwork.functions.text import prompt, words
from siltwork.session import stored

#: Hash buckets over which examples are numbered; first width of the search for examples that fit.
BUCKETS, WIDTH = 4096, 64


def _number(h: Column, digits: int = 12) -> Column:
    return F.conv(F.substring(h, 1, digits), 16, 10).cast("long")


def numbered(examples: DataFrame, seed: str = "0") -> DataFrame:
    """``examples`` (example_id, ...) in a seeded random order: ``at`` runs from 0 without gaps.

    Hash buckets are counted and summed up; rows are put in order only within their bucket.
    """
    keyed = examples.withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), "example_id"))).withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows
    offsets = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).select("bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket").orderBy("h", "example_id")
    ranked = keyed.withColumn("i", F.row_number().over(within) - 1).join(offsets, "bucket")
    return ranked.withColumn("at", F.col("offset") + F.col("i")).drop("h", "bucket", "i", "offset")


def start_of(query: Column, k: Column, n: int, seed: str = "0") -> Column:
    """Where in the order of ``n`` examples the choice for a query and number of shots begins."""
    return _number(F.md5(F.concat_ws("|", F.lit(seed), F.lit("start"), query, k.cast("string")))) % F.lit(n)


def shots(tests: DataFrame, shot_counts: tuple[int, ...]) -> DataFrame:
    return tests.withColumn("k", F.explode(F.array(*[F.lit(k) for k in shot_counts])))


def sample(tests: DataFrame, examples: DataFrame, shot_counts: tuple[int, ...] = (0, 1, 2, 3, 4), seed: str = "0") -> DataFrame:
    """``(query_id, k, shot, example_id)``: k examples per query without replacement, all if there are fewer.

    As many as needed follow each other in the random order from a random start, so queries meet examples in an
    equi-join on the place. A query is no example of its own: one more place is looked at, and its own left out.
    """
    order = stored(numbered(examples.select("example_id"), seed), "order")
    n = order.count()
    if not n:
        return order.select(F.lit("").alias("query_id"), F.lit(0).alias("k"), F.lit(0).alias("shot"), "example_id")
    wanted = shots(tests.select("query_id"), shot_counts).where("k > 0")
    wanted = wanted.select("query_id", "k", start_of(F.col("query_id"), F.col("k"), n, seed).alias("start"), F.explode(F.sequence(F.lit(0), F.least(F.col("k") + 1, F.lit(n)) - 1)).alias("shot"))
    met = wanted.withColumn("at", (F.col("start") + F.col("shot")) % n).join(order, "at")
    own = F.min(F.when(F.col("example_id") == F.col("query_id"), F.col("shot"))).over(Window.partitionBy("query_id", "k"))  # at most k + 1 rows
    shot = F.when(F.col("shot") > F.col("own"), F.col("shot") - 1).otherwise(F.col("shot"))
    rest = met.withColumn("own", own).where("own is null or shot <> own").withColumn("shot", shot.cast("int"))
    return rest.where("shot < k").select("query_id", "k", "shot", "example_id")


def disjoint(tests: DataFrame, examples: DataFrame, shot_counts: tuple[int, ...] = (1, 2, 3, 4), seed: str = "0") -> DataFrame:
    """``(query_id, k, shot, example_id)``: as ``sample``, of examples that share neither a word nor a top document.

    ``tests`` has ``(query_id, query, top_docs)``, ``examples`` ``(example_id, query, top_docs)``. Each query looks at a
    window of the random order and takes the first k that fit; those that found too few look at one twice as wide,
    until all are served or all examples seen. Most queries need the first window only.
    """
    order = stored(numbered(examples.select("example_id", words(F.col("query")).alias("ex_words"), F.coalesce("top_docs", F.array().cast("array<string>")).alias("ex_docs")), seed), "order")
    n = order.count()
    waiting = shots(tests.select("query_id", words(F.col("query")).alias("words"), F.coalesce("top_docs", F.array().cast("array<string>")).alias("docs")), shot_counts).where("k > 0")
    waiting = waiting.withColumn("start", start_of(F.col("query_id"), F.col("k"), max(1, n), seed))
    done, width = [], min(WIDTH, n)
    while n:
        waiting = stored(waiting, "waiting")
        seen = waiting.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("at", (F.col("start") + F.col("step")) % n).join(order, "at")
        fits = seen.where((F.size(F.array_intersect("words", "ex_words")) == 0) & (F.size(F.array_intersect("docs", "ex_docs")) == 0))
        first = fits.withColumn("shot", F.row_number().over(Window.partitionBy("query_id", "k").orderBy("step")) - 1).where(F.col("shot") < F.col("k"))
        first = stored(first.select("query_id", "k", "shot", "example_id"), "shots")
        served = first.groupBy("query_id", "k").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == F.col("k"))
        if width == n:
            done.append(first)
            break
        done.append(first.join(served.select("query_id", "k"), ["query_id", "k"], "left_semi"))
        waiting = waiting.join(served.select("query_id", "k"), ["query_id", "k"], "left_anti")
        if waiting.isEmpty():
            break
        width = min(n, width * 2)
    if not done:
        return order.select(F.lit("").alias("query_id"), F.lit(0).alias("k"), F.lit(0).alias("shot"), "example_id")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def prompts(tests: DataFrame, chosen: DataFrame, examples: DataFrame, shot_counts: tuple[int, ...]) -> DataFrame:
    """``(query_id, k, n_shots, prompt)``; ``n_shots`` is less than k where too few examples fit."""
    filled = chosen.join(examples.select("example_id", F.struct("query", "passage").alias("e")), "example_id")
    lists = filled.groupBy("query_id", "k").agg(F.array_sort(F.collect_list(F.struct("shot", "e"))).alias("l"))
    all_ = shots(tests.select("query_id", "query"), shot_counts).join(lists, ["query_id", "k"], "left")
    shown = F.coalesce(F.transform("l", lambda x: x["e"]), F.array().cast("array<struct<query:string,passage:string>>"))
    return all_.select("query_id", "k", F.size(shown).alias("n_shots"), prompt(shown, F.col("query")).alias("prompt"))


#: What a model is told before each prompt, and how it generates.
SYSTEM_PROMPT = "Write a passage that answers only the last query. Do not give answers for example queries."
TEMPERATURE, MAX_TOKENS, TOP_P = 0.5, 128, 1


class Generator(Protocol):
    """Makes one text per prompt. A remote model takes its credentials from the environment of the workers."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


@dataclass(frozen=True)
class ChatGenerator:
    """Asks a model behind a chat completion service, one request a prompt.

    ``key_variable`` names the variable of the workers' environment that holds the credential; without it none is sent.
    A failed request is tried again ``tries`` times in all, then the task fails.
    """

    url: str
    model: str
    key_variable: str | None = None
    system_prompt: str = SYSTEM_PROMPT
    temperature: float = TEMPERATURE
    max_tokens: int = MAX_TOKENS
    top_p: float = TOP_P
    timeout: float = 60.0
    tries: int = 3

    def body(self, prompt_: str) -> dict:
        messages = [{"role": "system", "content": self.system_prompt}, {"role": "user", "content": prompt_}]
        return {"model": self.model, "messages": messages, "temperature": self.temperature, "max_tokens": self.max_tokens, "top_p": self.top_p}

    def one(self, prompt_: str) -> str:
        headers = {"Content-Type": "application/json"}
        if self.key_variable:
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        request = urllib.request.Request(self.url, json.dumps(self.body(prompt_)).encode(), headers)
        for left in reversed(range(self.tries)):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"] or ""
            except OSError:
                if not left:
                    raise
                time.sleep(1.0)
        raise ValueError("tries must be at least 1")

    def __call__(self, prompts_: list[str]) -> list[str]:
        return [self.one(p) for p in prompts_]


def echo(prompts_: list[str]) -> list[str]:
    """Stand-in without a model: the passage of the last example, else the query."""
    out = []
    for p in prompts_:
        passages = [line[17:] for line in p.split("\n") if line.startswith("Example Passage: ")]
        queries = [line[7:] for line in p.split("\n") if line.startswith("Query: ")]
        out.append(passages[-1] if passages else queries[-1] if queries else "")
    return out


def generate(rows: DataFrame, generator: Generator = echo) -> DataFrame:
    """``rows`` with ``passage``, generated from ``prompt`` in batches; written once, as a model may not repeat itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(passage=generator(batch["prompt"].tolist()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", passage string"
    return stored(rows.mapInPandas(run, schema), "generated")
