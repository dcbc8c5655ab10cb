"""Commands of the retrieval and expansion pipelines: ``python -m siltwork.cli COMMAND ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import text as T
from siltwork.operators import dedup, fewshot, index, passages, rerank, search, vocabularies
from siltwork.sources import readers, writers

KINDS = {"0": "simple", "1": "bpe", "2": "wordpiece"}


def _corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, line_no, title, abstract, text, line)``: first object per id, ids in lower case."""
    rows = readers.json_lines(spark, path)
    first = dedup.pick(rows, F.lower("doc_id"), F.col("pos"))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    return first.select(F.lower("doc_id").alias("doc_id"), F.col("pos").alias("line_no"), "title", "abstract", text.alias("text"), "line")


def _vocabulary(docs: DataFrame, kind: str) -> vocabularies.Vocabulary:
    words = vocabularies.word_frequencies(vocabularies.train_entries(docs))
    return vocabularies.learn_bpe(words) if kind == "bpe" else vocabularies.learn_pieces(words)


def _kind(value: str) -> str:
    kind = KINDS.get(value, value)
    if kind not in KINDS.values():
        raise ValueError(f"tokenizer type {value}: not one of 0 (simple), 1 (bpe), 2 (wordpiece)")
    return kind


def clean(spark: SparkSession, a) -> None:
    """First line of every document id, as it was."""
    writers.raw_lines(_corpus(spark, a.corpus), a.out)


def build_dictionary(spark: SparkSession, a) -> None:
    docs, kind = _corpus(spark, a.corpus), _kind(a.tokenizer)
    if kind == "simple":
        vocabularies.learn_simple(docs).write.mode("overwrite").parquet(f"{a.out}/terms")
        spark.createDataFrame([(kind,)], "kind string").coalesce(1).write.mode("overwrite").parquet(f"{a.out}/kind")
    else:
        _vocabulary(docs, kind).save(spark, a.out)


def build_index(spark: SparkSession, a) -> None:
    docs, kind = _corpus(spark, a.corpus), _kind(a.tokenizer)
    tokens = None
    build_dictionary(spark, argparse.Namespace(corpus=a.corpus, tokenizer=kind, out=f"{a.out}/dict"))
    if kind != "simple":
        learned = vocabularies.Vocabulary.load(spark, f"{a.out}/dict")
        tokens = F.transform(vocabularies.encode(T.analyze(F.col("text")), learned), lambda x: x.cast("string"))
    index.Index.build(docs, tokens).save(a.out)


def run_search(spark: SparkSession, a) -> None:
    built = index.Index.load(spark, a.index)
    rows = readers.json_lines(spark, a.queries, readers.QUERIES)
    queries = rows.select(F.lower("query_id").alias("query_id"), F.concat_ws(" ", "title", "description", "narrative").alias("text"))
    kind = spark.read.parquet(f"{a.index}/dict/kind").first()["kind"]
    if kind != "simple":
        learned = vocabularies.Vocabulary.load(spark, f"{a.index}/dict")
        ids = vocabularies.encode(T.analyze(F.col("text")), learned)
        queries = queries.select("query_id", F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("text"))
    writers.run_file(search.with_zero_fill(built, queries, search.best(built, queries, a.k), a.k), a.out)


def extract(spark: SparkSession, a) -> None:
    docs = dedup.pick(readers.docs_tsv(spark, a.docs), F.col("doc_id"), F.col("pos"), last=True).select("doc_id", "text")
    queries = dedup.pick(readers.queries_tsv(spark, a.queries), F.col("query_id"), F.col("pos"), last=True).select("query_id", "query")
    rel = passages.relevant(readers.qrels(spark, a.qrels), queries)
    found = passages.diverse(passages.candidates(rel, docs)) if a.how == "diverse" else passages.random_passages(rel, docs)
    writers.passages(found.join(queries, "query_id"), a.out)


def expand(spark: SparkSession, a) -> None:
    examples = readers.examples(spark, a.passages).select(F.col("pos").cast("string").alias("example_id"), "query", "passage")
    tests = readers.queries_tsv(spark, a.tests).select("query_id", "query")
    counts = (0, 1, 2, 3, 4)
    if a.top_docs:
        train = dedup.pick(readers.queries_tsv(spark, a.train), F.col("query"), F.col("pos"), last=True)
        top = readers.top_docs(spark, a.top_docs).groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("top_docs"))
        full = examples.join(train.select("query", "query_id"), "query", "left").join(top, "query_id", "left").select("example_id", "query", "passage", "top_docs")
        chosen = fewshot.disjoint(tests.join(top, "query_id", "left"), full)
    else:
        chosen = fewshot.sample(tests, examples, counts)
    generator = fewshot.ChatGenerator(a.url, a.model, a.key_variable) if a.url else fewshot.echo
    made = fewshot.generate(fewshot.prompts(tests, chosen, examples, counts), generator)
    writers.generated(made.withColumn("passage", T.clean_generated(F.col("passage"))).join(tests, "query_id"), a.out)


def preprocess(spark: SparkSession, a) -> None:
    docs = dedup.pick(readers.id_text_tsv(spark, a.docs), F.col("doc_id"), F.col("pos"), last=True)
    if a.lemmas:
        tokens = T.preprocess_with_table(docs.select("doc_id", "text"), readers.lemma_table(spark, a.lemmas))
    else:
        tokens = docs.select("doc_id", T.preprocess(F.col("text"), T.lemma_rule).alias("tokens"))
    writers.preprocessed(tokens, a.out)


def score(spark: SparkSession, a) -> None:
    docs = dedup.pick(readers.id_text_tsv(spark, a.docs), F.col("doc_id"), F.col("pos"), last=True).select("doc_id", T.words(F.col("text")).alias("tokens"))
    made = readers.generated(spark, a.generated)
    both = F.concat_ws(" ", F.col("k").cast("string"), "query_id")
    query = T.expand_query(F.col("query"), T.preprocess(F.col("passage"), T.lemma_rule), preprocessed=a.preprocess_query)
    terms = made.select(both.alias("query_id"), F.explode(T.words(query)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    judged = dedup.pick(readers.qrels(spark, a.qrels), F.struct("query_id", "doc_id"), F.col("pos"), last=True)
    candidates = rerank.with_relevance(readers.top_docs(spark, a.top_docs), judged).join(made.select("query_id", "k"), "query_id").withColumn("query_id", both)
    scored = rerank.bm25(candidates, docs, terms).join(candidates.select("query_id", "doc_id", "rel"), ["query_id", "doc_id"])
    per_query = rerank.ndcg(scored).withColumn("k", F.split("query_id", " ")[0].cast("int"))
    writers.report(rerank.mean_ndcg(per_query, ["k"]), a.out)
    if a.ranking:
        writers.ranking(rerank.ranked(scored), a.ranking)


COMMANDS = {
    "clean": (clean, ["corpus", "out"]),
    "dictionary": (build_dictionary, ["corpus", "tokenizer", "out"]),
    "index": (build_index, ["corpus", "out", "tokenizer"]),
    "search": (run_search, ["queries", "out", "index", "--k"]),
    "diverse-passages": (extract, ["docs", "queries", "qrels", "out"]),
    "random-passages": (extract, ["docs", "queries", "qrels", "out"]),
    "expand": (expand, ["passages", "tests", "out", "--url", "--model", "--key-variable"]),
    "expand-disjoint": (expand, ["passages", "tests", "train", "top_docs", "out", "--url", "--model", "--key-variable"]),
    "preprocess": (preprocess, ["docs", "out", "--lemmas"]),
    "score": (score, ["docs", "generated", "top_docs", "qrels", "out", "--ranking", "--preprocess-query"]),
}

OPTIONS = {"--k": {"type": int, "default": 100}, "--preprocess-query": {"action": "store_true"}}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="siltwork")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (_, names) in COMMANDS.items():
        p = sub.add_parser(name)
        for n in names:
            p.add_argument(n, **OPTIONS.get(n, {}))
    a = parser.parse_args(args)
    a.how = a.command.split("-")[0]
    a.top_docs = getattr(a, "top_docs", None)
    COMMANDS[a.command][0](spark or SparkSession.builder.appName("siltwork").getOrCreate(), a)


if __name__ == "__main__":
    main()
