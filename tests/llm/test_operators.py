"""Problems 2, 3, 8, 9 and 10 against plain Python on small inputs with the awkward cases."""

import random
import re
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltwork.llm import bpe, mixing, pii, queries, terms, topn
from siltwork.session import scratch_path

VOCABULARY = Path(bpe.TOKENIZERS) / bpe.VOCABULARY
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="no public vocabulary here")


def test_top_items(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), f"d{rng.randrange(30)}", rng.choice([0.0, -0.0, 1.5, -2.0, float("nan"), None, rng.random()])) for _ in range(600)]
    rows += [("hot", f"x{i:05}", float(i % 50)) for i in range(2000)] + [("few", "z", 1.0), ("few", None, 2.0)]
    got = topn.top_items(spark.createDataFrame(rows, "q string, d string, s double"), "q", "d", "s", 10).collect()
    best = {}
    for q, d, s in rows:
        if q is not None and d is not None and s is not None and s == s:
            best[q, d] = max(best.get((q, d), s), s)
    expected = set()
    for q in {k[0] for k in best}:
        items = sorted(((s, d) for (g, d), s in best.items() if g == q), key=lambda x: (x[0], x[1].encode()), reverse=True)
        expected |= {(q, d, i + 1) for i, (_, d) in enumerate(items[:10])}
    assert {(r["q"], r["d"], r["rank"]) for r in got} == expected
    counted = topn.counted_rows(spark.createDataFrame(rows, "q string, d string, s double"), "q", "d", "s")
    plan = topn.first_items(counted, 10, 30)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and plan.count("Exchange hashpartitioning") == 1


def test_top_items_of_groups_with_many_repeats(spark):
    rows = [("same", "a", float(i)) for i in range(500)] + [("same", x, -1.0) for x in "bcd"] + [("few", "a", 1.0)] * 20 + [("two", x, 0.0) for x in "ab"] * 7
    rows += [("wide", f"{i % 9}", float(i)) for i in range(90)]
    got = {tuple(r) for r in topn.top_items(spark.createDataFrame(rows, "q string, d string, s double"), "q", "d", "s", 4).collect()}
    assert got == {("same", "a", 499.0, 1), ("same", "d", -1.0, 2), ("same", "c", -1.0, 3), ("same", "b", -1.0, 4), ("few", "a", 1.0, 1), ("two", "b", 0.0, 1), ("two", "a", 0.0, 2)} | {
        ("wide", f"{i % 9}", float(i), 90 - i) for i in range(86, 90)
    }
    clash = spark.createDataFrame([("q", "d", 1.0, 7)], "q string, d string, s double, _score int")
    assert [tuple(r) for r in topn.top_items(clash, "q", "d", "s", 4).collect()] == [("q", "d", 1.0, 1)]
    assert topn.top_items(clash.limit(0), "q", "d", "s", 4).count() == 0


def _terms(text):
    text = "".join(c for c in text or "" if ord(c) < 128).lower()
    for c in ",.:;\"'\t\n\x0b\f\r":
        text = text.replace(c, " ")
    return [t for t in text.split(" ") if t]


def _counts(records):
    n, df = Counter(), Counter()
    for text in records.values():
        n.update(_terms(text))
        df.update(set(_terms(text)))
    return {t: (n[t], df[t]) for t in n}


def test_term_deltas(spark):
    rng = random.Random(2)
    words = ["Virus", "naïve", "a.b", "it's", "x", "long" * 50, "K", "tab\tbed"]
    make = lambda: rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randrange(9)))])
    state = terms.TermState(spark, scratch_path(spark, "test-terms"))
    records = {f"k{i}": make() for i in range(60)}
    for _ in range(4):
        state.apply(spark.createDataFrame(list(records.items()), "key string, text string"))
        got = {r["term"]: (r["n_occurrences"], r["n_records"]) for r in state.counts().collect()}
        assert got == _counts(records)
        assert state.n_records() == len(records)
        for k in list(records)[:20]:
            if rng.random() < 0.4:
                del records[k]
        records |= {f"k{rng.randrange(90)}": make() for _ in range(15)}
    state.apply(spark.createDataFrame([], "key string, text string"))
    assert state.counts().count() == 0


def test_term_state_is_opened_again(spark):
    folder = scratch_path(spark, "test-terms")
    first, second = {"a": "x y y", "b": "z", "c": None}, {"a": "x", "b": "z", "d": "y w"}
    make = lambda r: spark.createDataFrame(list(r.items()), "key string, text string")
    terms.TermState(spark, folder).apply(make(first))
    make(first).write.parquet(f"{folder}/v2/records")  # a run that failed
    for records in (first, second, {}, second):
        if records is not first:
            terms.TermState(spark, folder).apply(make(records))
        again = terms.TermState(spark, folder)
        assert {r["term"]: (r["n_occurrences"], r["n_records"]) for r in again.counts().collect()} == _counts(records)
        assert again.n_records() == len(records)


def test_term_changes_and_segments(spark, monkeypatch):
    monkeypatch.setattr(terms, "MAX_SEGMENTS", 3)
    rng, folder = random.Random(11), scratch_path(spark, "test-terms")
    records: dict = {}
    terms.TermState(spark, folder, buckets=5)
    for step in range(6):
        feed = {f"k{rng.randrange(12)}": rng.choice([None, "", "x y", "x x z.z", "w"]) for _ in range(6)}
        gone = {k for k in feed if rng.random() < 0.3}
        rows = [(k, None if k in gone else t, k in gone) for k, t in feed.items()] + [(None, "none", False)]
        records = {k: t for k, t in (records | feed).items() if k not in gone}
        state = terms.TermState(spark, folder, buckets=5 if step == 0 else 99)
        state.apply_changes(spark.createDataFrame(rows, "key string, text string, deleted boolean"))
        again = terms.TermState(spark, folder)
        assert again.n_buckets == 5 and len(again._segments) <= 3
        assert {r["term"]: (r["n_occurrences"], r["n_records"]) for r in again.counts().collect()} == _counts(records)
        assert again.n_records() == len(records) and {tuple(r) for r in again.records().collect()} == set(records.items())


def test_found_terms_come_out_of_a_delta(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a", "x y"), (2, "A ", "x z z"), (3, "b", "x")], "line_no bigint, doc_id string, text string")
    docs.write.parquet(str(tmp_path / "cord19_trec_covid_docs.parquet"))
    signs, signed_counts = [], terms.signed_counts
    monkeypatch.setattr(terms, "signed_counts", lambda rows: signs.append({r["sign"] for r in rows.collect()}) or signed_counts(rows))
    assert {tuple(r) for r in queries.p3_counts(spark, str(tmp_path)).collect()} == {("x", 2, 2, "rare"), ("y", 1, 1, "rare")}
    assert signs == [{1}, {1, -1}]


def test_term_records(spark):
    rows = [(3, " A1", "late"), (1, "a1", "first"), (2, None, "none"), (4, "b", None)]
    got = {tuple(r) for r in terms.first_records(spark.createDataFrame(rows, "line_no bigint, doc_id string, text string")).collect()}
    assert got == {("a1", "first"), ("b", None)}


@needs_vocabulary
def test_byte_bpe():
    tiktoken = pytest.importorskip("tiktoken")
    ours = bpe.ByteBpe(str(VOCABULARY))
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    theirs = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ours.ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", "a" * 3000, "<|endoftext|> x", "\x1c\x1d 　  x", "ก" * 500, " \n\n  y", "it's 5½ \U0001f468‍⚕️"]
    texts += ["".join(rng.choice("ab \n'sé病123.,ทด́") for _ in range(rng.randrange(200))) for _ in range(400)]
    for t in texts:
        assert ours.encode(t) == theirs.encode_ordinary(t)
    assert ours.encode(None) == []


def test_rank_bitmap():
    rng = random.Random(4)
    bits, members = bpe.RankBitmap(300_000), set()
    for _ in range(3000):
        i = rng.randrange(300_000)
        if rng.random() < 0.6:
            bits.add(i)
            members.add(i)
        elif members:
            i = rng.choice(sorted(members))
            bits.remove(i)
            members.discard(i)
        assert bits.first() == min(members, default=-1)


def test_fit():
    rng = random.Random(5)
    for _ in range(150):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 6) for _ in lengths]
        rest, width = rng.randrange(0, 400), rng.choice([8, 64, 1 << 16])
        take = mixing.fit(lengths, counts, rest, width)
        got = sum(n * t for n, t in zip(lengths, take, strict=True))
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        total = sum(n * c for n, c in zip(lengths, counts, strict=True))
        assert got <= max(rest, 0) or total <= rest
        if total <= rest:
            assert got == total


def test_fit_is_exact_below_the_width():
    rng = random.Random(10)
    for _ in range(200):
        lengths = rng.sample(range(1, 40), rng.randrange(1, 7))
        counts = [rng.randrange(1, 5) for _ in lengths]
        rest = rng.randrange(0, 150)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        take = mixing.fit(lengths, counts, rest, 1 << 16)
        assert sum(n * t for n, t in zip(lengths, take, strict=True)) == max(s for s in sums if s <= rest)
        # wider than the programme: never above, and not further below than without a choice of the shortest
        take = mixing.fit(lengths, counts, rest, 32)
        got = sum(n * t for n, t in zip(lengths, take, strict=True))
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True)) and (got <= rest)
        left = [n for n, t, c in zip(lengths, take, counts, strict=True) if t < c]
        assert not left or got + min(left) > rest


def test_found_sources_come_out_of_the_fit(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 7)], "doc_id bigint, key string, n_tokens int")
    planned = mixing.plan(df, spark.createDataFrame([("a", 0.9, 2), ("b", 0.1, 1)], "source string, target_share double, max_repeats int"))
    found = mixing.unreachable(df, planned)
    assert "FlatMapGroupsInPandas" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r["source"] for r in found.collect()] == ["a"]


def test_mix(spark):
    rng = random.Random(6)
    sizes = [(i, rng.choice(["a", "a", "a", "b", "c", None, ""]), rng.choice([0, 3, 5, 8, 13])) for i in range(900)]
    targets = [(" A ", 0.2, 3), ("b", 0.5, 2), ("c", 0.3, 9), ("none", 0.0, 1), ("gone", 0.1, 5), (None, 0.1, 1)]
    df = spark.createDataFrame(sizes, "doc_id bigint, key string, n_tokens int")
    planned = mixing.plan(df, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    total = sum(n for _, _, n in sizes)
    have = Counter()
    for _, k, n in sizes:
        have[k] += n
    short = {s for s, share, reps in targets if s and reps * have[s.strip().lower()] < share * total}
    assert {r["source"] for r in mixing.unreachable(df, planned).collect()} == short
    rows = {r["source"]: r for r in mixing.report(df, planned).collect()}
    mixed = mixing.mixed(df, planned).collect()
    by_id = {i: (k, n) for i, k, n in sizes}
    tokens = Counter()
    for r in mixed:
        assert by_id[r["doc_id"]][1] == r["n_tokens"] > 0
        tokens[r["source"]] += r["n_tokens"] * r["copies"]
    for s, share, reps in targets:
        if s:
            assert tokens[s] == rows[s]["tokens"] and max([r["copies"] for r in mixed if r["source"] == s], default=0) <= reps
            if s not in short:
                assert abs(tokens[s] - round(share * total)) <= 2
            else:
                assert tokens[s] == reps * have[s.strip().lower()]
    assert mixed and len({r["doc_id"] for r in mixed}) == len(mixed)
    assert sorted(map(tuple, mixing.mixed(df.repartition(7), planned).collect())) == sorted(map(tuple, mixed))
    empty = df.limit(0)
    assert mixing.report(empty, mixing.plan(empty, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))).count() == 5


PLACES = [
    ("Mail a.b+c@mail.site.example, or x_1 [at] site [dot] test now.", [("email", "a.b+c@mail.site.example"), ("email", "x_1 [at] site [dot] test")]),
    ("As told to y@EXAMPLE.ORG; user@ and @host are not, the tool @ 2011 ranked.", [("email", "y@EXAMPLE.ORG")]),
    ("请联系v@mednet.example或拨打+81 3 0000 0009。电话:010-00007492。", [("email", "v@mednet.example"), ("phone", "+81 3 0000 0009"), ("phone", "010-00007492")]),
    ("call +1 (202) 555-0112 ext. 7 or 01632 960 058. Lot 555-030-2867 held 120-180-296 units.", [("phone", "+1 (202) 555-0112 ext. 7"), ("phone", "01632 960 058")]),
    ("tel. 555 30 22 31 y (030) 23125421", [("phone", "555 30 22 31"), ("phone", "(030) 23125421")]),
    ("SSN 666 40 9044, DNI 49.838.286-O, QQ 65 75 79 C. Catalogue no. 666-47-8963 is a kit.", [("id_number", "666 40 9044"), ("id_number", "49.838.286-O"), ("id_number", "QQ 65 75 79 C")]),
    ("lives at 221B Pine Road, Flat 3A, Millford 00890 and", [("address", "221B Pine Road, Flat 3A, Millford 00890")]),
    ("The Hazel Street cohort; Ward 637 Road map.", []),
    ("wohnt in Lindenweg 12b, 00617 Hartmere. habite au 108 bis, avenue Lind.", [("address", "Lindenweg 12b, 00617 Hartmere"), ("address", "108 bis, avenue Lind")]),
    ("Ask Mrs. Frost or Nurse Ana B. Osk about it. Frost delayed us.", [("person", "Frost"), ("person", "Ana B. Osk")]),
    ("Signed, Osk-Marsh, Ana. By A. Osk's ward; the Osk syndrome, Osk et al., ana osk.", [("person", "Osk-Marsh, Ana"), ("person", "A. Osk"), ("person", "ana osk")]),
    ("Said Ana Velor and Borin Osk; the U.K. Results of Ana Velor.", [("person", "Ana Velor"), ("person", "Borin Osk"), ("person", "Ana Velor")]),
]


@pytest.mark.parametrize(
    "text, kind, place",
    [
        ("電話は０３－１２３４－５６７８です", "phone", "０３－１２３４－５６７８"),
        ("Ring (555) 123-4567x1234", "phone", "(555) 123-4567x1234"),
        ("Ring +1 (555) 123-4567ext. 12", "phone", "+1 (555) 123-4567ext. 12"),
        ("Ring 01614960123x12", "phone", "01614960123x12"),
        ("Ring +1-(555)-1234567x9", "phone", "+1-(555)-1234567x9"),
        ("| AB-1234567 |\n", "id_number", "AB-1234567"),
        ("| A/12345678 |", "id_number", "A/12345678"),
        ("card PT/1234/56, paid", "id_number", "PT/1234/56"),
        ("under QQ657579C.", "id_number", "QQ657579C"),
        ("x_1 [At] site [Dot] test", "email", "x_1 [At] site [Dot] test"),
        ("x_1 at site Dot test", "email", "x_1 at site Dot test"),
        ("at 12 Pine\tRoad now", "address", "12 Pine\tRoad"),
        ("at 12 Pine\xa0STREET now", "address", "12 Pine\xa0STREET"),
        ("wohnt Im\nWinkel 12 jetzt", "address", "Im\nWinkel 12"),
    ],
)
def test_hints_leave_out_no_form(text, kind, place):
    assert [(k, text[a:b]) for k, a, b in pii.fixed_places(text)] == [(kind, place)]


def test_hints_and_guards_change_nothing(monkeypatch):
    rng = random.Random(13)
    parts = [t for t, _ in PLACES] + ["0161/496001", "[AT] x [dot] yz", " at a.b Dot org", "M-7009764", "ZZ 0802 806", "12 Oak\xa0Street", "Zum\nAnger 4", "３－1234", "+1 (", "555)", " 5 ", "x", "\t", "ул. Лесная, 5"]
    texts = ["".join(p[(i := rng.randrange(len(p))) : i + rng.randrange(1, 30)] + rng.choice(["", " ", "\n", "\xa0"]) for p in rng.choices(parts, k=12)) for _ in range(1500)]
    guarded = [pii.fixed_places(t) for t in texts]
    monkeypatch.setattr(pii, "_AT_HINTS", ("",))
    monkeypatch.setattr(pii, "ADDRESSES", [(form, [""]) for form, _ in pii.ADDRESSES])
    monkeypatch.setattr(pii, "SIX_DIGITS", re.compile(""))
    assert [pii.fixed_places(t) for t in texts] == guarded and sum(map(len, guarded)) > 300


def test_numbers_by_shape(spark):
    texts = ["Passport no. ZZ0561325 and ZZ 0882 219 again.", "Seen [ZZ0532420]. Trial NCT04123456, NCT 0412 3457 and GSE123456 were bare.", "Patient record M-7041272; also M-7957366."]
    texts += ["Grant no. AB1234567 and lot AB1234568, kit AB1234569; patient record AB1234560 (AB7654321)."] + ["Lot 312-555-0123."] * 40 + ["So 312-555-0199 it is, ratio 0161/496001."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    none = spark.createDataFrame([], "entry string, kind string")
    got = sorted((r["doc_id"], texts[r["doc_id"]][r["span_start"] : r["span_end"]]) for r in pii.places(docs, none).where("pii_type <> 'person'").collect())
    # a shape that is mostly something else is left alone, but for the number that has the label itself
    assert got == [(0, "ZZ 0882 219"), (0, "ZZ0561325"), (1, "ZZ0532420"), (2, "M-7041272"), (2, "M-7957366"), (3, "AB1234560")]


def test_many_places_of_one_text_in_linear_time():
    text = "at 12 Pine Road, Millford 00890 and (202) 555-0112 by Ana Osk; " * 6000
    names = pii.Names({"ana"}, {"osk"})
    began = time.time()
    places, taken = pii.graded_places(text, {})
    people = list(pii.person_forms(text, pii._words(text), names, taken))
    assert len(places) == 12000 and len(people) >= 6000 and time.time() - began < 20


def test_places(spark):
    docs = [(i, t) for i, (t, _) in enumerate(PLACES)] + [(100, None), (101, ""), (102, "plain " * 2000), (103, "By week 3 it ended. By then, By now.")]
    names = [("Ana", "given"), ("Osk", "family"), ("Frost", "family"), ("Marsh", "family"), ("Ana", "given"), (None, "given")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = pii.places(df, spark.createDataFrame(names, "entry string, kind string"))
    got = sorted((r["doc_id"], r["span_start"], r["span_end"], r["pii_type"]) for r in found.collect())
    texts = dict(docs)
    for i, (_, expected) in enumerate(PLACES):
        assert sorted((k, texts[d][a:b]) for d, a, b, k in got if d == i) == sorted(expected), i
    clean = {r["doc_id"]: r["text"] for r in pii.replaced(df, found).collect()}
    assert len(clean) == len(docs) and clean[100] is None and clean[102] == texts[102]
    assert clean[0] == "Mail [EMAIL], or [EMAIL] now." and clean[9] == "Ask Mrs. [PERSON] or Nurse [PERSON] about it. Frost delayed us."
    nothing = spark.createDataFrame([], "entry string, kind string")
    assert "Frost" in {texts[9][r["span_start"] : r["span_end"]] for r in pii.places(df.where(F.col("doc_id") == 9), nothing).collect()}


def test_ordinary_words_beside_names_written_small(spark):
    texts = ["Ask Ana Often or Velor Osk; Ana Velor and Often Osk.", "saw ana often and often osk; ana velor and velor osk; ana osk-lind.", "It often, often is. " * 40, "Ana Osk came."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    names = spark.createDataFrame([("Ana", "given"), ("Osk", "family")], "entry string, kind string")
    got = sorted((r["doc_id"], texts[r["doc_id"]][r["span_start"] : r["span_end"]]) for r in pii.places(docs, names).collect())
    capital = [(0, x) for x in ("Ana Often", "Ana Velor", "Often Osk", "Velor Osk")]
    assert got == capital + [(1, x) for x in ("ana osk-lind", "ana velor", "velor osk")] + [(3, "Ana Osk")]


def test_overlaps_with_dropped_places_only(spark):
    rng = random.Random(8)
    spans = [(1, "person", 0, 10), (1, "person", 8, 20), (1, "person", 15, 25), (1, "person", 25, 30)]
    spans += [(d, "person", a, a + rng.randrange(1, 12)) for d in range(2, 8) for a in rng.sample(range(90), 20)]
    got = {(r[0], r[2], r[3]) for r in pii.without_overlaps(spark.createDataFrame(spans, "doc_id bigint, pii_type string, span_start int, span_end int")).collect()}
    expected, ends = set(), {}
    for d, _, a, b in sorted(spans, key=lambda x: (x[0], x[2], -x[3])):
        if ends.get(d, 0) <= a:
            expected.add((d, a, b))
            ends[d] = b
    assert got == expected and (1, 15, 25) in got


def test_names_one_a_line(spark):
    texts = ["Unlisted Kelström\nMirel Dorvin\nMirel Kelström", "Unlisted Kelström came. Unlisted Kelström left."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    names = spark.createDataFrame([("Mirel", "given"), ("Kelström", "family"), ("Dorvin", "family")], "entry string, kind string")
    got = sorted((r["doc_id"], r["span_start"], r["span_end"]) for r in pii.places(docs, names).collect())
    assert [texts[d][a:b] for d, a, b in got] == ["Unlisted Kelström", "Mirel Dorvin", "Mirel Kelström"] + ["Unlisted Kelström"] * 2


@needs_vocabulary
def test_ids_in_spark(spark):
    rows = [(1, None), (2, ""), (3, "hello world")]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", bpe.ids_of(F.col("text"))).collect()}
    assert got == {1: [], 2: [], 3: [31373, 995]}
