"""The best documents of many queries: against plain Python, with small bounds of memory, and without a row per pair."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siltwork.operators import index, search, topk


@pytest.mark.parametrize("cells, expanded, waiting, heavy", [(1 << 20, 1 << 20, 1 << 19, 8192), (64, 5, 7, 10), (64, 1, 1, 1), (64, 1 << 20, 50, 1e9)])
def test_best_in_blocks(monkeypatch, cells, expanded, waiting, heavy):
    for name, value in zip(("CELLS", "EXPANDED", "WAITING", "HEAVY"), (cells, expanded, waiting, heavy), strict=True):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    docs = {f"d{i:03}": Counter(rng.choice(list("abcdefgh"), rng.integers(1, 6)).tolist()) for i in range(300)}
    docs |= {f"e{i}": docs["d007"] for i in range(40)}
    order = rng.permutation(list(docs)).tolist()
    rows = [(f"q{i}", t, 3 + ord(t) % 4, rng.random()) for i in range(20) for t in rng.choice(list("abcdefghz"), 2, replace=False).tolist()]
    block = topk.Block.of(pa.table(dict(zip(("query_id", "term", "df", "qw"), map(list, zip(*rows, strict=True)), strict=True))), len(docs))
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))
    table = pa.table({"doc_id": order, "terms": pa.array([[{"term": t, "tf": n} for t, n in docs[d].items()] for d in order], kind)})
    got = pa.Table.from_batches(list(topk.best(iter(table.slice(3).to_batches(max_chunksize=70) + table.slice(0, 3).to_batches()), block, 9))).to_pylist()
    expected = {}
    for d, terms in docs.items():
        norm = np.sqrt(sum(w * w for w in sorted(1 + np.log2(n) for n in terms.values())))
        for q, t, _, qw in rows:
            if t in terms:
                expected.setdefault(q, {}).setdefault(d, []).append((1 + np.log2(terms[t])) / norm * qw)
    best = {q: sorted(((round(sum(x), 9), d) for d, x in s.items()), reverse=True)[:9] for q, s in expected.items()}
    mine = {q: sorted(((round(r["score"], 9), r["doc_id"]) for r in got if r["query_id"] == q), reverse=True) for q in {r["query_id"] for r in got}}
    assert {q: [s for s, _ in x] for q, x in mine.items()} == {q: [s for s, _ in x] for q, x in best.items()}
    for q, listed in mine.items():  # equal documents by greater id
        same = [d for d in sorted(docs, reverse=True) if docs[d] == docs["d007"]]
        held = [d for _, d in listed if d in same]
        assert held == same[: len(held)]


def test_best_is_the_same_as_ranked(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i:03}", f"w{i % 7} w{i % 3} x y{i % 11}") for i in range(150)], "doc_id string, text string")
    queries = spark.createDataFrame([(f"q{i}", f"w{i % 9} x x y{i}") for i in range(30)] + [("none", "zzz"), ("empty", ""), ("null", None)], "query_id string, text string")
    built = index.Index.by_document(docs)
    assert built.n_docs == 150 and sorted(map(tuple, built.norms.collect())) == [(d, pytest.approx(n)) for d, n in sorted(map(tuple, index.document_norms(built.tf).collect()))]
    every = {(r["query_id"], r["doc_id"]): r["score"] for r in search.scores(built, queries).collect()}
    expected = {(r["query_id"], r["rank"]): pytest.approx(r["score"]) for r in search.ranked(search.scores(built, queries), 12).collect()}

    def same(found):
        rows = found.collect()
        assert len({(r["query_id"], r["doc_id"]) for r in rows}) == 360 and {(r["query_id"], r["rank"]): r["score"] for r in rows} == expected
        assert all(r["score"] == pytest.approx(every[r["query_id"], r["doc_id"]]) for r in rows)

    same(search.best(built, queries, 12))
    monkeypatch.setattr(search, "BLOCK_PLACES", 100)
    same(search.best(index.Index.build(docs), queries, 12))
    assert search.best(built, queries.where("query_id >= 'z'"), 12).count() == search.best(index.Index.by_document(docs.limit(0)), queries, 12).count() == 0


def written(spark):
    """Bytes that the session has shuffled so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()


@pytest.mark.parametrize("name", ["tfidf_top100", "tfidf_zero_fill"])
def test_pairs_are_not_shuffled(spark, tmp_path, name):
    from siltwork.plans import retrieval

    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("cord19_trec_covid_docs", [(i, f"d{i}", f"all w{i}", None) for i in range(4000)], "line_no bigint, doc_id string, title string, abstract string")
    put("queries_file", [(f"{i}00", f"all w{i}", None, None, None) for i in range(1, 301)], "query_id string, title string, description string, narrative string, loaded_at timestamp")
    before = written(spark)
    got = retrieval.QUERIES[name](spark, str(tmp_path)).collect()
    moved = written(spark) - before
    assert Counter(Counter(r["query_id"] for r in got).values()) == {100: 300}
    assert all(f"d{i}" in {r["doc_id"] for r in got if r["query_id"] == f"{i}00"} for i in (1, 17, 300))
    assert moved < 4 * 300 * 100 * 32, moved  # a row per pair would be 1,200,000
