"""Problems 4, 5 and 7 against plain Python on small inputs with the awkward cases."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltwork.operators import parsing, references, skew

T0 = datetime(2021, 1, 15)


def _orphans(qrels, loads, removed):
    out = set()
    for line, q, d, at in qrels:
        for field, raw in (("query_id", q), ("doc_id", d)):
            key = (raw or "").strip().lower()
            if not key or at is None:
                continue
            own = [t for k, t in loads[field] if k and k.strip().lower() == key and t]
            gone = [t for f, k, t in removed if f == field and k and k.strip().lower() == key and t]
            before = [t for t in own if t <= at]
            if before and not [t for t in gone if max(before) <= t <= at]:
                continue
            out.add((line, field, "missing" if not own else "late" if not before else "removed", at.strftime("%Y-%m")))
    return out


@pytest.mark.parametrize("hot, joined, rows", [(0, 1000, 2_000_000), (400, 1000, 2_000_000), (400, 2, 5)])
def test_orphans(spark, hot, joined, rows, monkeypatch):
    monkeypatch.setattr(references, "BROADCAST_HISTORY", 3)
    monkeypatch.setattr(references, "JOINED_HISTORY", joined)
    monkeypatch.setattr(references, "HEAVY_ROWS", rows)
    rng = random.Random(hot)
    day = lambda: T0 + timedelta(hours=rng.randrange(0, 24 * 50, 12))
    keys = [f"D{i}" for i in range(12)]
    spelled = lambda k: rng.choice([k, k.lower(), f" {k}", f"{k}\t"])
    docs = [(spelled(rng.choice(keys[:9])), day()) for _ in range(20)] + [("D0", day()) for _ in range(hot // 4)] + [(None, T0), ("D3", None)]
    queries = [(spelled(rng.choice(keys[:5])), day()) for _ in range(6)]
    removed = [(rng.choice(["doc_id", "query_id"]), spelled(rng.choice(keys)), day()) for _ in range(12)] + [("doc_id", "D0", day()) for _ in range(hot // 8)]
    qrels = [(i, rng.choice([spelled(rng.choice(keys)), None, "  "]), spelled(rng.choice(keys)), rng.choice([day(), None]) if i % 7 == 0 else day()) for i in range(120)]
    qrels += [(1000 + i, spelled("D1"), spelled("D0"), day()) for i in range(hot)]
    names = {"doc_id": "docs_file", "query_id": "queries_file"}
    make = spark.createDataFrame
    found = references.orphans(
        make(qrels, "line_no bigint, query_id string, doc_id string, judged_at timestamp_ntz"),
        {"doc_id": make(docs, "doc_id string, loaded_at timestamp_ntz"), "query_id": make(queries, "query_id string, loaded_at timestamp_ntz")},
        make([(names[f], k, t) for f, k, t in removed], "table_name string, key_value string, removed_at timestamp_ntz"),
    ).collect()
    expected = _orphans(qrels, {"doc_id": docs, "query_id": queries}, removed)
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_orphans_without_keys(spark):
    make = spark.createDataFrame
    empty = {f: make([], f"{f} string, loaded_at timestamp_ntz") for f in references.FIELDS}
    gone = make([], "table_name string, key_value string, removed_at timestamp_ntz")
    q = make([(1, "q", "d", T0)], "line_no bigint, query_id string, doc_id string, judged_at timestamp_ntz")
    assert {r["reason"] for r in references.orphans(q, empty, gone).collect()} == {"missing"}
    assert references.orphans(q.limit(0), empty, gone).count() == 0


LINES = [
    ("D123456789\tu\tt\ttext", None, ["D123456789", "u", "t", "text"]),
    ("\ufeff d123456789 \t\t\t\"a\tb\"\"c\nd\"\r", None, ["d123456789", "", "", 'a\tb"c\nd']),
    ("D123456789\tu\tt\tsay \"hi\" now", None, ["D123456789", "u", "t", 'say "hi" now']),
    ('D123456789\tu\tt\t"open', "quoting", None),
    ('D123456789\tu\tt\t"a" b', "quoting", None),
    ('"D123456789"\tu\tt\t"x"""', None, ["D123456789", "u", "t", 'x"']),
    ('D123456789\tu\tt\t"""', "quoting", None),
    ("D123456789\tu\tt", "columns", None),
    ("D123456789\tu\tt\tx\ty", "columns", None),
    ("", "columns", None),
    (None, "columns", None),
    ("D12345678\tu\tt\tx", "doc_id", None),
    ("E123456789\tu\tt\tx", "doc_id", None),
    ("D１23456789\tu\tt\tx", "doc_id", None),
    ("D123456789\tu\tt\t \u00a0 ", "text", None),
    ("D123456789\tu\tt\t", "text", None),
    ("D123456789\tu\tt\ta\x07b", "text", None),
    ("D123456789\tu\tt\ta\ufffdb", "text", None),
    ("D123456789\tu\tt\ta\rb", "text", None),
    ("D123456789\tu\tt\ta\nb", None, ["D123456789", "u", "t", "a\nb"]),
    ("\tu\tt\tx", "doc_id", None),
    ("D123456789\tu\tt\t" + '"' + 'a""' * 60000 + '"', None, ["D123456789", "u", "t", 'a"' * 60000]),
    ("D123456789" + "\t" * 70000, "columns", None),
]


def test_lines(spark):
    raw = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LINES)], "line_no bigint, line string")
    bad = {r["line_no"]: r["reason"] for r in parsing.rejected(raw).collect()}
    good = {r["line_no"]: [r["doc_id"], r["url"], r["title"], r["text"]] for r in parsing.loaded(raw).collect()}
    for i, (line, reason, fields) in enumerate(LINES):
        assert bad.get(i) == reason, (i, line and line[:40])
        assert good.get(i) == fields, (i, line and line[:40])
    assert parsing.rejected(raw.limit(0)).count() == 0


def test_heavy_keys_and_totals(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(200), f"d{rng.randrange(300)}", rng.choice([1, 2, None])) for _ in range(3000)]
    rows += [(7, f" D{i}", 1) for i in range(1500)] + [(i % 90, "HOT", 5) for i in range(900)] + [(None, "d1", 1), (1, None, 1)]
    df = spark.createDataFrame(rows, "term_id int, doc_id string, tf int")
    pairs = {(t, d.strip().lower()) for t, d, _ in rows if t is not None and d is not None}
    by = {"term_id": Counter(str(t) for t, _ in pairs), "doc_id": Counter(d for _, d in pairs)}
    expected = {(f, k) for f, c in by.items() for k, n in c.items() if n * 100 >= 2 * len(pairs)}
    found = skew.heavy_keys(skew.pairs_of(df)).collect()
    assert {(r["key_field"], r["key_value"]) for r in found} == expected and len(found) == len(expected)
    for r in skew.totals(skew.pairs_of(df)).collect():
        assert r["n_partners"] == by[r["key_field"]][r["key_value"]]
    assert skew.heavy_keys(skew.pairs_of(df.limit(0))).count() == 0


def test_quantiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([rng.randrange(-(2**31), 2**31), rng.randrange(5), None])) for _ in range(800)]
    got = {(r["k"], r["quantile"]): (r["n"], r["value"]) for r in skew.key_quantiles(spark.createDataFrame(rows, "k int, v int"), ["k"], "v", [0.0, 0.5, 0.9, 1.0]).collect()}
    values = defaultdict(list)
    for k, v in rows:
        if v is not None:
            values[k].append(v)
    for k, vs in values.items():
        vs.sort()
        for q in (0.0, 0.5, 0.9, 1.0):
            rank = max(1, -int(-(q * len(vs)) // 1))
            assert got[k, q] == (len(vs), vs[rank - 1])


def test_quantiles_of_wide_values(spark):
    rng = random.Random(12)
    ends = [-(2**63), 2**63 - 1, -1, 0, 1, -(2**31) - 1, 2**31, 2**48, -(2**48)]
    rows = [(rng.choice(["a", "a", "b"]), rng.choice([rng.choice(ends), rng.randrange(-(2**63), 2**63), rng.randrange(-3, 3)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "quantile string, v bigint")
    got = {(r[0], r[1]): (r[2], r[3]) for r in skew.key_quantiles(df, ["quantile"], "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    for k in "ab":
        vs = sorted(v for x, v in rows if x == k)
        for q in (0.0, 0.25, 0.5, 1.0):
            assert got[k, q] == (len(vs), vs[max(1, -int(-(q * len(vs)) // 1)) - 1])
    small = spark.createDataFrame([(1, -128), (1, 127), (1, 5)], "k int, v int").select("k", F.col("v").cast("tinyint").alias("v"))
    assert [r["value"] for r in skew.key_quantiles(small, ["k"], "v", [0.5]).collect()] == [5]
    assert skew.key_quantiles(df.limit(0), ["quantile"], "v", [0.5]).count() == 0
    with pytest.raises(ValueError):
        skew.key_quantiles(spark.createDataFrame([(1, 0.5)], "k int, v double"), ["k"], "v", [0.5])


def test_heavy_keys_at_the_very_share(spark):
    rows = [(t, f"d{i}") for t in range(50) for i in range(t * 20, t * 20 + 20)]
    rows += [(t, f"e{t}-{i}") for t in range(50, 60) for i in range(19)]
    df = spark.createDataFrame([(t, d, 1) for t, d in rows], "term_id int, doc_id string, tf int")
    n = len(rows)
    for share in ((20, n), (19, n), (21, n), (1, 1)):
        got = {r["key_value"] for r in skew.heavy_keys(skew.pairs_of(df), share).collect() if r["key_field"] == "term_id"}
        assert got == {str(t) for t, c in Counter(t for t, _ in rows).items() if c * share[1] >= n * share[0]}
