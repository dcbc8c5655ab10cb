"""Retrieval, expansion and evaluation against plain Python on small inputs, and text formats there and back."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltwork.functions import registry
from siltwork.functions import text as T
from siltwork.operators import dedup, fewshot, index, ordering, passages, rerank, search, vocabularies
from siltwork.sources import readers, writers


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [('It\'s A.B, c:d;e "f"', ["it", "s", "a", "b", "c", "d", "e", "f"]), ("naïve it’s", ["nave", "its"]), ("K İ", []), ("a\nb", ["a\nb"]), (None, []), ("", [])],
)
def test_analyze(spark, text, expected):
    assert one(spark, T.analyze, text) == expected
    if text == "a\nb":
        assert one(spark, lambda c: T.analyze(c, T.WHITESPACE), text) == ["a", "b"]


def test_text_functions(spark):
    assert one(spark, T.chunks, "A. B. C. D") == ["A. B. C", "D"]
    assert one(spark, T.chunks, "") == []
    assert one(spark, T.first_sentences, "A. B. C. D") == "A. B. C"
    assert one(spark, T.clean_generated, "a\n\nb\t\tc   d") == "a b c d"
    assert one(spark, lambda c: T.expand_query(c, F.array(F.lit("t"))), "q") == "q q q q q t"
    example = F.array(F.struct(F.lit("q").alias("query"), F.lit("p").alias("passage")))
    assert one(spark, lambda c: T.prompt(example, c), "x") == "Example Query: q\nExample Passage: p\n\nQuery: x\nPassage: "
    assert one(spark, T.preprocess, "The doctor didn't see  well-known Mice, 5 of it's") == ["doctor", "see", "mice"]
    assert one(spark, lambda c: T.preprocess(c, T.lemma_rule), "viruses studies glass classes wolves") == ["virus", "study", "glass", "class", "wolf"]
    assert one(spark, T.words, " a   b\n") == ["a", "b"]


def test_pick(spark):
    df = spark.createDataFrame([("A", 2, None), ("a", 1, "x"), ("b", 1, "y"), (None, 0, "z"), ("a", 1, "x")], "id string, pos int, v string")
    key = F.lower("id")
    assert sorted(map(tuple, dedup.pick(df, key, F.col("pos")).collect())) == [("a", 1, "x"), ("b", 1, "y")]
    assert sorted(map(tuple, dedup.pick(df, key, F.col("pos"), last=True).collect())) == [("A", 2, None), ("b", 1, "y")]
    assert dedup.pick(df.limit(0), key, F.col("pos")).count() == 0


def test_tfidf(spark):
    docs = spark.createDataFrame([("d1", "a a b"), ("d2", "b"), ("d3", None), ("d4", "")], "doc_id string, text string")
    queries = spark.createDataFrame([("q1", "a"), ("q2", "zzz"), ("q3", None)], "query_id string, text string")
    built = index.Index.build(docs)
    assert built.n_docs == 2
    scored = search.scores(built, queries)
    got = {tuple(r)[:2]: r["score"] for r in search.ranked(scored, 10).collect()}
    assert got == {("q1", "d1"): pytest.approx(2 * math.log2(3) / math.sqrt(5))}
    filled = {(r["query_id"], r["doc_id"]): r["rank"] for r in search.with_zero_fill(built, queries, scored, 10).collect()}
    assert filled == {("q1", "d1"): 1, ("q1", "d2"): 2, ("q2", "d2"): 1, ("q2", "d1"): 2, ("q3", "d2"): 1, ("q3", "d1"): 2}


def test_index_is_saved_and_blocks_are_bounded(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i:03}", "hot " + "w" * (i % 5)) for i in range(200)], "doc_id string, text string")
    built = index.Index.build(docs)
    built.save(str(tmp_path))
    again = index.Index.load(spark, str(tmp_path))
    assert again.n_docs == 200 and sorted(map(tuple, again.tf.collect())) == sorted(map(tuple, built.tf.collect()))
    lists = [r for r in index.postings(built.tf, per_block=30).collect() if r["term"] == "hot"]
    assert len(lists) > 3 and sorted(p["doc_id"] for r in lists for p in r["postings"]) == [f"d{i:03}" for i in range(200)]
    assert all([p["doc_id"] for p in r["postings"]] == sorted(p["doc_id"] for p in r["postings"]) for r in lists)


def test_bm25(spark):
    rng = random.Random(2)
    docs = {f"d{i}": [rng.choice("abcdefg") for _ in range(rng.randrange(12))] for i in range(14)}
    candidates = {"q1": [f"d{i}" for i in range(9)] + ["missing"], "q2": ["d3"], "q3": ["missing"]}
    terms = {"q1": Counter("aabz"), "q2": Counter("c"), "q3": Counter("a")}
    make = spark.createDataFrame
    got = rerank.bm25(
        make([(q, d) for q, ds in candidates.items() for d in ds for _ in (0, 1)], "query_id string, doc_id string"),
        make(list(docs.items()), "doc_id string, tokens array<string>"),
        make([(q, t, n) for q, c in terms.items() for t, n in c.items()], "query_id string, term string, qtf bigint"),
    )
    got = {(r[0], r[1]): r[2] for r in got.collect()}
    expected = {}
    for q, ds in candidates.items():
        held = [d for d in ds if d in docs]
        n, df = len(held), Counter(t for d in held for t in set(docs[d]))
        idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
        floor = 0.25 * sum(idf.values()) / len(idf) if idf else 0
        idf = {t: floor if v < 0 else v for t, v in idf.items()}
        for d in held:
            tf, dl, avg = Counter(docs[d]), len(docs[d]), sum(len(docs[x]) for x in held) / n
            expected[q, d] = sum(c * idf[t] * tf[t] * 5.46 / (tf[t] + 4.46 * (0.18 + 0.82 * dl / avg)) for t, c in terms[q].items() if tf[t])
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_bm25_of_the_run(spark, tmp_path):
    from siltwork.plans import retrieval

    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("cord19_trec_covid_docs", [(i, f"D{i}", t, None) for i, t in enumerate(["a b", "b c", "c d", "d e"])], "line_no bigint, doc_id string, title string, abstract string")
    put("queries_file", [("1", "a", None, None, None), ("2", "c", None, None, None)], "query_id string, title string, description string, narrative string, loaded_at timestamp")
    put("qrels_file", [(1, "1", "d1", 2)], "line_no bigint, query_id string, doc_id string, rel int")
    run = [("1", " D0", 0.5), ("1", "d0", None), ("1", "d1", 0.1), ("1", "d2", 0.1), ("1", "gone", 9.0), ("2", "d3", 1.0), ("3", "d0", 1.0), (None, "d0", 1.0)]
    put("run_file", run, "query_id string, doc_id string, score double")
    got = {(r["query_id"], r["doc_id"]): (r["score"], r["rel"]) for r in retrieval.QUERIES["bm25_run"](spark, str(tmp_path)).collect()}
    assert {k: v[1] for k, v in got.items()} == {("1", "d0"): 0, ("1", "d1"): 2, ("1", "d2"): 0, ("2", "d3"): 0}
    assert got["1", "d0"][0] > 0 and got["1", "d1"][0] == got["1", "d2"][0] == 0


def test_ndcg(spark):
    rng = random.Random(3)
    rows = [(f"q{q}", rng.choice([0.5, 1.0, rng.random()]), rng.choice([0, 0, 1, 2])) for q in range(6) for _ in range(rng.randrange(1, 70))] + [("one", 1.0, 3), ("none", 2.0, 0)]
    got = {(r[0], r[1]): r[2] for r in rerank.ndcg(spark.createDataFrame(rows, "query_id string, score double, rel int")).collect()}
    for q in {r[0] for r in rows}:
        own = sorted(((s, g) for x, s, g in rows if x == q), key=lambda x: -x[0])
        for k in rerank.CUTOFFS:
            dcg, i = 0.0, 0
            while i < len(own):
                j = i
                while j < len(own) and round(own[j][0], 9) == round(own[i][0], 9):
                    j += 1
                dcg += sum(g for _, g in own[i:j]) / (j - i) * sum(1 / math.log2(r + 2) for r in range(i, min(j, k)))
                i = j
            ideal = sum(g / math.log2(r + 2) for r, g in enumerate(sorted((g for _, g in own), reverse=True)[:k]))
            assert got[q, k] == pytest.approx(dcg / ideal if ideal else 0.0), (q, k)
            assert -1e-9 <= got[q, k] <= 1 + 1e-9


def _diverse(texts, n=5):
    import re

    if len(texts) <= n:
        return list(range(len(texts)))
    bags = [Counter(re.findall(r"\b\w\w+\b", t.lower())) for t in texts]
    df = Counter(t for b in bags for t in b)
    vectors = []
    for b in bags:
        v = {t: c * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, c in b.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        vectors.append({t: x / norm for t, x in v.items()})
    if not df:
        return [0]
    picked, sims = [0], [0.0] * len(texts)
    while len(picked) < n:
        for i, v in enumerate(vectors):
            sims[i] += sum(x * vectors[picked[-1]].get(t, 0) for t, x in v.items())
        rest = [(round(sims[i] / len(picked), 12), i) for i in range(len(texts)) if i not in picked]
        rest = [x for x in rest if x[0] < 1 - 1e-12]
        if not rest:
            break
        picked.append(min(rest)[1])
    return picked


def test_diverse(spark):
    rng = random.Random(4)
    pool = ["alpha", "beta", "gamma", "delta", "x", "I", "eps"]
    groups = {f"q{g}": [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 25))] for g in range(5)}
    groups |= {"copies": ["alpha beta"] * 7, "letters": ["x I"] * 8, "few": ["same", "same"]}
    rows = [(q, i, 0, t) for q, ts in groups.items() for i, t in enumerate(ts)]
    for in_task in (passages.IN_TASK, 0, 40):  # in one task, by steps, and both
        got = passages.diverse(spark.createDataFrame(rows, "query_id string, pos bigint, chunk int, passage string"), in_task=in_task).collect()
        by = {}
        for r in sorted(got, key=lambda r: (r["query_id"], r["step"])):
            by.setdefault(r["query_id"], []).append(r["pos"])
        assert by == {q: _diverse(ts) for q, ts in groups.items()}
        assert by["copies"] == [0]


def test_postings_in_blocks(spark):
    rng = random.Random(6)
    tf = [(t, f"d{i:03}", rng.randrange(1, 4)) for t, n in (("hot", 100), ("seven", 7), ("eight", 8), ("one", 1)) for i in rng.sample(range(200), n)]
    got = {(r["term"], r["block"]): (r["df"], [tuple(p) for p in r["postings"]]) for r in index.postings(spark.createDataFrame(tf, "term string, doc_id string, tf bigint"), 7).collect()}
    expected = {}
    for t in {x[0] for x in tf}:
        rows = sorted((d, n) for term, d, n in tf if term == t)
        expected |= {(t, b): (len(rows), rows[b * 7 : b * 7 + 7]) for b in range(-(-len(rows) // 7))}
    assert got == expected


def test_frequencies_need_no_shuffle_after_deduplication(spark):
    docs = dedup.pick(spark.createDataFrame([("A", 1, "x y"), ("a", 2, "z")], "doc_id string, line_no bigint, text string"), F.lower("doc_id"), F.col("line_no"), as_key="doc_id")
    assert index.term_frequencies(docs)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in index.term_frequencies(docs).collect()} == {("x", "a", 1), ("y", "a", 1)}


def test_places_over_ranges(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aaab"), i) for i in rng.sample(range(-(10**12), 10**12), 400)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    assert {r["v"]: r["place"] for r in ordering.with_place(df, ["v"]).collect()} == {v: i for i, v in enumerate(sorted(v for _, v in rows))}
    expected = {(g, v): i for g in "ab" for i, v in enumerate(sorted(v for x, v in rows if x == g))}
    assert {(r["g"], r["v"]): r["place"] for r in ordering.with_place(df, ["v"], ["g"]).collect()} == expected
    assert ordering.with_place(df.limit(0), ["v"]).count() == 0


def test_ranked_and_unmatched_candidates(spark):
    rows = [("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 2.0), ("r", "a", 0.0)]
    got = rerank.ranked(spark.createDataFrame(rows, "query_id string, doc_id string, score double")).collect()
    assert {(r["query_id"], r["doc_id"]): r["rank"] for r in got} == {("q", "c"): 1, ("q", "a"): 2, ("q", "b"): 3, ("r", "a"): 1}
    docs = spark.createDataFrame([("a",), ("a",), ("b",)], "doc_id string")
    assert {tuple(r) for r in rerank.unmatched(spark.createDataFrame(rows, "query_id string, doc_id string, score double"), docs).collect()} == {("q", 3, 1), ("r", 1, 0)}


def test_disjoint_widens_until_all_are_served(spark, monkeypatch):
    monkeypatch.setattr(fewshot, "WIDTH", 2)
    tests = [("t1", "cat dog", ["d1"]), ("t2", "cow", None), ("t3", "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9", [])]
    examples = [(f"e{i}", f"w{i} " + ("cat" if i % 3 else "Dog"), [f"d{i % 4}"] if i % 2 else None) for i in range(10)] + [("last", "free", ["d9"])]
    make = spark.createDataFrame
    got = fewshot.disjoint(make(tests, "query_id string, query string, top_docs array<string>"), make(examples, "example_id string, query string, top_docs array<string>")).collect()
    fits = {t: {e for e, q, ds in examples if not set(q.split()) & set(w.split()) and not set(ds or []) & set(d or [])} for t, w, d in tests}
    for t, _, _ in tests:
        for k in (1, 2, 3, 4):
            chosen = [r["example_id"] for r in got if r["query_id"] == t and r["k"] == k]
            assert len(set(chosen)) == len(chosen) == min(k, len(fits[t])) and set(chosen) <= fits[t]
    prompts = fewshot.prompts(make(tests, "query_id string, query string, top_docs array<string>"), fewshot.disjoint(make(tests, "query_id string, query string, top_docs array<string>"), make(examples, "example_id string, query string, top_docs array<string>")), make([(e, q, "p") for e, q, _ in examples], "example_id string, query string, passage string"), (0, 2))
    rows = {(r["query_id"], r["k"]): r for r in prompts.collect()}
    assert rows["t3", 2]["n_shots"] == 1 and rows["t1", 0]["prompt"] == "Query: cat dog\nPassage: "
    assert len(fewshot.generate(prompts).collect()) == 6


def test_sampling_without_enough_examples(spark):
    tests = spark.createDataFrame([("a",), ("b",)], "query_id string")
    few = spark.createDataFrame([("e1",), ("e2",)], "example_id string")
    got = Counter((r["query_id"], r["k"]) for r in fewshot.sample(tests, few).collect())
    assert got == {(q, k): min(k, 2) for q in "ab" for k in (1, 2, 3, 4)}
    assert fewshot.sample(tests, few.limit(0)).count() == 0


def _learn(words, kind, size):
    tokens = [chr(i) for i in range(128)] if kind == "bpe" else [x for i in range(128) for x in (chr(i), " " + chr(i))]
    state = [([ord(c) for c in " " + w], f) if kind == "bpe" else ([ord(c) * 2 + (i == 0) for i, c in enumerate(w)], f) for w, f in words.items() if kind == "bpe" or len(w) > 1]
    weight = lambda t, f: math.sqrt(f) if tokens[t].strip(" ").isalnum() and len(tokens[t].strip(" ")) else f
    merges = []
    while len(tokens) < size:
        pairs, single = Counter(), Counter()
        for s, f in state:
            for t in s:
                single[t] += f
            for p in zip(s, s[1:], strict=False):
                pairs[p] += f
        if not pairs:
            break
        best = max(pairs, key=lambda p: (pairs[p] if kind == "bpe" else pairs[p] / weight(p[0], single[p[0]]) / weight(p[1], single[p[1]]), p))
        merges.append((*best, len(tokens)))
        tokens.append(tokens[best[0]] + tokens[best[1]])
        joined = []
        for s, f in state:
            out, i = [], 0
            while i < len(s):
                if tuple(s[i : i + 2]) == best:
                    out.append(len(tokens) - 1)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            joined.append((out, f))
        state = joined
    return tokens, merges


@pytest.mark.parametrize("kind, size", [("bpe", 150), ("wordpiece", 275)])
def test_vocabularies(spark, kind, size):
    rng = random.Random(5)
    words = {"".join(rng.choice("aabe-1") for _ in range(rng.randrange(1, 8))): rng.randrange(1, 30) for _ in range(60)}
    df = spark.createDataFrame(list(words.items()), "term string, freq bigint")
    learn = vocabularies.learn_bpe if kind == "bpe" else vocabularies.learn_pieces
    got = learn(df, size)
    assert (got.tokens, got.merges) == _learn(words, kind, size)
    few = learn(df, 128 + 3 if kind == "bpe" else 256 + 3, driver_words=0)
    assert few.merges == got.merges[:3]
    texts = [[*words, "é", "zz"], [], None]
    ids = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "w array<string>").select(vocabularies.encode(F.col("w"), got)).collect()]
    assert ids[1:] == [[], []]
    if kind == "bpe":
        assert "".join(got.tokens[i] for i in ids[0] if i < len(got.tokens)).startswith("".join(" " + w for w in words))
    else:
        assert "".join(got.tokens[i] for i in vocabularies.PieceEncoder(got)("abea")) == " abea"
        assert vocabularies.PieceEncoder(got)("éa")[0] == len(got.tokens)


def test_one_word_is_exhausted(spark):
    got = vocabularies.learn_bpe(spark.createDataFrame([("ab", 3)], "term string, freq bigint"))
    assert got.tokens[128:] == ["ab", " ab"]
    assert vocabularies.learn_bpe(spark.createDataFrame([], "term string, freq bigint")).merges == []


def test_vocabulary_is_saved(spark, tmp_path):
    made = vocabularies.Vocabulary("bpe", ["\n", ",", "a b"], [(0, 1, 2)])
    made.save(spark, str(tmp_path / "v"))
    assert vocabularies.Vocabulary.load(spark, str(tmp_path / "v")) == made


def test_formats(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    rows = readers.json_lines(spark, put("c.json", '{"n":3,"doc_id":"AbC","title":"x\\"y","abstract":"z"}\n{"title":"t"}\nbroken\n')).orderBy("pos").collect()
    assert [(r["doc_id"], r["title"], r["abstract"]) for r in rows] == [("AbC", 'x"y', "z"), (None, "t", None), (None, None, None)]
    assert one(spark, lambda c: readers.field(c, "doc_id"), '{"doc_id":"AbC"}') == "abc"
    assert [r["doc_id"] for r in readers.docs_tsv(spark, put("d.tsv", "d1\tu\tt\tx\nd2\tu\tx\nd3\tu\tt\t\n")).collect()] == ["d1"]
    assert [tuple(r)[1:] for r in readers.id_text_tsv(spark, put("i.tsv", "a\tb\tc\nx\n")).orderBy("pos").collect()] == [("a", "b\tc"), ("x", None)]
    assert [tuple(r)[1:] for r in readers.qrels(spark, put("q", "1 d1 -1 0\n1\td2\t0\t0\n")).orderBy("pos").collect()] == [("1", "d1", -1), ("1", "d2", 0)]
    assert readers.qrels(spark, put("t", "1 0 d1 2\n"), readers.QRELS_TREC).first()["doc_id"] == "d1"
    ranked = spark.createDataFrame([("q", "d2", 1.23456789, 2), ("q", "d1", 12.5, 1)], "query_id string, doc_id string, score double, rank int")
    writers.run_file(ranked, str(tmp_path / "run"))
    assert [tuple(r) for r in readers.run_file(spark, str(tmp_path / "run")).collect()] == [("q", 0, "d1", 12.5), ("q", 0, "d2", 1.23457)]
    made = spark.createDataFrame([("q", 1, "x", "a\nb", "p")], "query_id string, k int, query string, prompt string, passage string")
    writers.generated(made, str(tmp_path / "g"))
    assert readers.generated(spark, str(tmp_path / "g")).first()["prompt"] == "a\\nb"
    for _ in range(2):
        writers.report(spark.createDataFrame([(0, 5, 0.5)], "k int, cutoff int, ndcg double"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).count() == 2
    writers.preprocessed(spark.createDataFrame([("d", ["a", "b"])], "doc_id string, tokens array<string>"), str(tmp_path / "p"))
    assert readers.id_text_tsv(spark, str(tmp_path / "p")).first()["text"] == "a b"


def test_stream(spark, tmp_path):
    from siltwork.streaming import ingest

    src = str(tmp_path / "in")
    spark.sql("select 'd1' as doc_id, 'a a b' as text, timestamp'2024-01-01' as loaded_at union all select 'd1', 'c', timestamp'2024-01-01 01:00:00'").coalesce(1).write.parquet(src)
    stream = ingest.first_deliveries(ingest.documents(spark, src))
    ingest.index_stream(stream, str(tmp_path / "tf"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "tf")).select("term", "tf").collect())) == [("a", 2), ("b", 1)]


def test_functions_for_sql(spark):
    words = spark.createDataFrame([("abab", 5), ("ab", 3), ("cab", 2)], "term string, freq bigint")
    bpe, pieces = vocabularies.learn_bpe(words, 131), vocabularies.learn_pieces(words, 259)
    assert registry.register(spark, bpe, pieces) == ["analyze_simple", "bpe_encode", "wordpiece_encode"]
    spark.createDataFrame([(1, "Abab, c\"d; 'é"), (2, None), (3, "a\tb c:d")], "id int, text string").createOrReplaceTempView("texts_for_sql")
    got = {r["id"]: r["t"] for r in spark.sql("select id, analyze_simple(text) as t from texts_for_sql").collect()}
    assert got == {1: ["abab", "c", "d"], 2: [], 3: ["a\tb", "c", "d"]}
    row = spark.sql("select bpe_encode(analyze_simple('abab cab')) as b, wordpiece_encode(array('abab', 'é')) as p").first()
    one = lambda v, w: (vocabularies.BpeEncoder if v is bpe else vocabularies.PieceEncoder)(v)(w)
    assert row["b"] == one(bpe, "abab") + one(bpe, "cab") and row["p"] == one(pieces, "abab") + one(pieces, "é")


def test_generated_files_with_and_without_shots(spark, tmp_path):
    (tmp_path / "four").write_text("".join(f"q{i // 5}\tquery {i}\tprompt\\n\tpassage {i}\n" for i in range(15)))
    (tmp_path / "five").write_text("q1\t3\tquery\tprompt\tpassage\nbad line\n")
    got = sorted((r["query_id"], r["k"], r["query"], r["passage"]) for r in readers.generated(spark, str(tmp_path / "four")).collect())
    assert got == sorted((f"q{i // 5}", i % 5, f"query {i}", f"passage {i}") for i in range(15))
    assert [(r["query_id"], r["k"]) for r in readers.generated(spark, str(tmp_path / "five")).collect()] == [("q1", 3)]


def test_rejected_lines_are_counted(spark, tmp_path):
    (tmp_path / "docs").write_text("d1\tu\tt\tx\nd2\tu\tt\n\n  d3\tu\tt\ty\t\n")
    assert tuple(readers.rejected_tsv(spark, str(tmp_path / "docs")).first()) == (4, 2)
    assert readers.docs_tsv(spark, str(tmp_path / "docs")).count() == 2


def test_lemmas_out_of_a_table(spark, tmp_path):
    (tmp_path / "lemmas").write_text("mice\tmouse\nWolves\twolf\nmice\tmouses\nleft\n")
    texts = spark.createDataFrame([("a", "The mice left 3 wolves; mice"), ("b", None), ("c", "the")], "doc_id string, text string")
    got = {r["doc_id"]: r["tokens"] for r in T.preprocess_with_table(texts, readers.lemma_table(spark, str(tmp_path / "lemmas"))).collect()}
    assert got == {"a": ["mouse", "left", "wolf", "mouse"], "b": [], "c": []}


def test_query_in_expansion_may_be_preprocessed(spark):
    row = spark.createDataFrame([("The Mice", ["x"])], "q string, t array<string>")
    assert row.select(T.expand_query(F.col("q"), F.col("t"), 2)).first()[0] == "The Mice The Mice x"
    assert row.select(T.expand_query(F.col("q"), F.col("t"), 2, preprocessed=True)).first()[0] == "mice mice x"


def test_sample_leaves_out_a_query_of_its_own(spark):
    ids = spark.createDataFrame([(f"q{i}",) for i in range(6)], "query_id string")
    got = {}
    for r in fewshot.sample(ids, ids.withColumnRenamed("query_id", "example_id"), (0, 2, 5, 9)).collect():
        got.setdefault((r["query_id"], r["k"]), []).append((r["shot"], r["example_id"]))
    for (q, k), chosen in got.items():
        assert sorted(s for s, _ in chosen) == list(range(min(k, 5)))
        assert q not in {e for _, e in chosen} and len({e for _, e in chosen}) == len(chosen)
    assert len(got) == 18


def test_chat_generator(spark, monkeypatch):
    import http.server
    import json
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.headers.get("Authorization"), body))
            if len(seen) == 1:
                self.send_error(503)
                return
            out = json.dumps({"choices": [{"message": {"content": body["messages"][1]["content"].upper()}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("CHAT_KEY", "abc")
    monkeypatch.setattr(fewshot.time, "sleep", lambda s: None)
    make = fewshot.ChatGenerator(f"http://127.0.0.1:{server.server_port}/v1", "some-model", "CHAT_KEY")
    assert make(["one", "two"]) == ["ONE", "TWO"]
    body = seen[-1][1]
    assert seen[-1][0] == "Bearer abc" and body["messages"][0] == {"role": "system", "content": fewshot.SYSTEM_PROMPT}
    assert (body["model"], body["temperature"], body["max_tokens"], body["top_p"]) == ("some-model", 0.5, 128, 1) and len(seen) == 3
    server.shutdown()


def test_scratch_can_be_dropped(spark):
    from pathlib import Path

    from siltwork import session

    other = Path(session.scratch_dir(spark)) / "siltwork" / "other-application"
    other.mkdir(parents=True, exist_ok=True)
    df = session.stored(spark.range(3), "kept")
    assert df.count() == 3 and session.drop_scratch(spark) and other.is_dir()
    assert not list(other.parent.glob(f"{spark.sparkContext.applicationId}*")) and session.drop_scratch(spark) in (True, False)
    assert session.stored(spark.range(2), "kept").count() == 2
