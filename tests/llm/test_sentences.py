import random
import re
from bisect import bisect_left

import numpy as np
import pytest

from siltwork.llm import pieces
from siltwork.llm.sentences import Function, replayed, scan, scan_chunk, sentence_units, units, unpack

CASES = [
    ("The dose was 5.5 mg at 5 p.m. It was sold by Dr. Frost et al. for $4.1 million.", ["The dose was 5.5 mg at 5 p.m.", "It was sold by Dr. Frost et al. for $4.1 million."]),
    ('"Is it safe?" asked one nurse. Ms. Osk asked: "Who? Me." Then it ended.', ['"Is it safe?" asked one nurse.', 'Ms. Osk asked: "Who? Me."', "Then it ended."]),
    ("RESULTS\nIt rose (see Table 2). mRNA fell...  Why?! The Zap! kit.", ["RESULTS", "It rose (see Table 2).", "mRNA fell...", "Why?!", "The Zap! kit."]),
    ("Done.\n1. one vs. two\n2. three\n• four\nEnd of it", ["Done.", "1. one vs. two", "2. three", "• four", "End of it"]),
    ("wrapped at a\nline end. Next\n\ncut", ["wrapped at a\nline end.", "Next", "cut"]),
    ("他说:“样本失败了。剂量没有。”样本恢复。“安全吗?”护士问道。", ["他说:“样本失败了。剂量没有。”", "样本恢复。", "“安全吗?”护士问道。"]),
    ("医師は「低下した。」と記した。本当ですか!?", ["医師は「低下した。」と記した。", "本当ですか!?"]),
    ("Am 5. und 7. Mai sank z. B. der Wert. „Gut?“, fragte er.", ["Am 5. und 7. Mai sank z. B. der Wert.", "„Gut?“, fragte er."]),
    ("ไข้ลดลง แพทย์ใช้ abc แล้ว หลาย ๆ แห่ง", ["ไข้ลดลง", "แพทย์ใช้ abc แล้ว", "หลาย ๆ แห่ง"]),
    ("यह कब रुकेगा? \"कब?\" नर्स ने पूछा। सूची बनी॥ ठीक", ["यह कब रुकेगा?", '"कब?" नर्स ने पूछा।', "सूची बनी॥", "ठीक"]),
    ("(Not reviewed.) Next one.", ["(Not reviewed.)", "Next one."]),
    ("   \n ", []),
    (None, []),
    ("An open (bracket. It never\n\ncloses. Ok.", ["An open (bracket. It never", "closes.", "Ok."]),
    ("The answer was no. We left. See no. 7 and art. 5.", ["The answer was no.", "We left.", "See no. 7 and art. 5."]),
    ("It is state of the art. It is hepatitis B. The virus spreads.", ["It is state of the art.", "It is hepatitis B.", "The virus spreads."]),
    ("Give vitamin C. Patients rest. By nurse B. Osk and J. The.", ["Give vitamin C.", "Patients rest.", "By nurse B. Osk and J. The."]),
    ("It took 5 min. Then it ended. Die max. Dosis war 5.", ["It took 5 min.", "Then it ended.", "Die max. Dosis war 5."]),
    ("We met Don. He and Al. Osk et al. The end.", ["We met Don.", "He and Al.", "Osk et al. The end."]),
    ("m².3 rose 3.5-fold to v2.0.1 now. Ok", ["m².3 rose 3.5-fold to v2.0.1 now.", "Ok"]),
]


@pytest.mark.parametrize("text, expected", CASES)
def test_units(text, expected):
    assert [text[a:b] for a, b in zip(*units(text), strict=True)] == expected


def in_chunks(text, size, halo):
    """Units by way of chunks: functions, scan, replay; cut beside letters only."""
    places = [m.start() for m in re.finditer(r"(?<=[^\W_])[^\W_]", text)]
    cuts = [0]
    while (at := bisect_left(places, cuts[-1] + size)) < len(places):
        cuts.append(places[at])
    cuts.append(len(text))
    parts, functions, base = [], [], []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        left = max(0, a - halo)
        at = bisect_left(places, b + halo)
        right = places[at] if at < len(places) else len(text)
        found, (n, _, first, until, packed, f) = scan_chunk(text[left:right], a - left, b - left, k, False)
        assert unpack(packed) == found and n == b - a
        state, start = np.frombuffer(f, np.int64).reshape(2, -1)
        functions.append(Function(state, np.where(start >= 0, start + a, start)))
        parts.append((found, first, a, a + until))
    starts, ends = [], []
    for (found, first, a, until), state, start in zip(parts, *scan(functions), strict=True):
        s, e, state, start = replayed(found, first, state, start, a)
        starts, ends = starts + s, ends + e
    if state:
        starts.append(start)
        ends.append(until)
    return starts, ends


def test_chunks_compose_to_the_whole():
    rng = random.Random(5)
    for _ in range(120):
        text = rng.choice(["", " ", "\n"]).join(rng.choice(CASES[:12])[0] for _ in range(12)) + rng.choice(["", " ", " ( x", "\n"])
        for size in (7, 40, 150):
            assert in_chunks(text, size, 80) == units(text)


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5, 60])
def test_brackets_of_any_depth(depth):
    rng = random.Random(depth)
    text = "It (" + "see (deep. One " * (depth - 1) + "three. Four five." + " end) It. Then" * (depth - 1) + ") rose. Next one."
    assert [text[a:b] for a, b in zip(*units(text), strict=True)][-1] == "Next one." and len(units(text)[0]) == 2
    for _ in range(20):
        text = "".join(rng.choice(["(a. B ", "x) C. D", "[e. F ", "] g. H ", "so. It ", "\n\n", "（i. ", "）J. "] + ["(k. L "] * (depth % 7)) for _ in range(3 * depth + 5))
        for size in (5, 30):
            assert in_chunks(text, size, 60) == units(text), text


@pytest.mark.parametrize("gap", [1, 15, 16, 17, 300, 5000])
def test_closing_marks_far_behind_the_end(gap):
    for fill in (" ", "\xa0", "”"):
        text = "(It rose." + fill * gap + ") Next one."
        got = [text[a:b] for a, b in zip(*units(text), strict=True)]
        assert got[-1] == "Next one.", (gap, fill)
    text = "x" * 30 + ' He said "it rose.' + " " * gap + '" Next one came.'
    whole = units(text)
    assert [text[a:b] for a, b in zip(*whole, strict=True)][-1] == "Next one came."
    assert in_chunks(text, 20, 5) == whole


def test_long_documents_in_spark(spark):
    rng = random.Random(6)
    docs = [(f"d{i}", " ".join(rng.choice(CASES[:12])[0] for _ in range(rng.choice([1, 40])))) for i in range(12)] + [("n", None), ("e", ""), (None, "No id.")]
    docs += [("long", "x y. Z " * 3000), ("spaces", "One." + " " * 9000 + "Two."), ("marks", "So (" + '("' * 2000 + "end.")]
    expected = {(d, a, b) for d, t in docs if d and t for a, b in zip(*units(t), strict=True)}
    for size in (300, 2000):
        got = sentence_units(spark.createDataFrame(docs, "doc_id string, text string"), size=size).collect()
        assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_pieces(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(CASES[:12])[0] for _ in range(rng.choice([5, 60]))) for _ in range(8)]
    texts += ["x" * 5000, "é" * 3001 + " end. " * 400, "", None, "病" * 900, " " * 4000, "ok"]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    limit, overlap = 500, 60
    rows = pieces.ranges(docs, limit, 700)
    got = {}
    for r in pieces.pieces(rows, limit, overlap).collect():
        got.setdefault(r["doc_id"], []).append(r)
    flags = {r[0]: r[1] for r in pieces.oversized(pieces.boundary_tables(rows, overlap), limit).collect()}
    assert flags == {r[0]: r[1] for r in pieces.oversized(pieces.boundary_tables(rows, overlap, limit), limit).collect()}
    for i, t in enumerate(texts):
        big = t is not None and len(t.encode()) > limit
        assert (f"d{i}" in got) == big == (f"d{i}" in flags)
        if not big:
            continue
        ps = sorted(got[f"d{i}"], key=lambda r: r["piece"])
        assert ps[0]["piece_start"] == 0 and ps[-1]["piece_end"] == len(t)
        for p in ps:
            assert p["text"] == t[p["piece_start"] : p["piece_end"]] and len(p["text"].encode()) == p["n_bytes"] <= limit
        for p, q in zip(ps, ps[1:], strict=False):
            assert p["piece_start"] < q["piece_start"] and p["piece_end"] < q["piece_end"]
            assert t[min(p["piece_end"], q["piece_start"]) : max(p["piece_end"], q["piece_start"])].strip() == "" or q["shared"] == p["piece_end"] - q["piece_start"] > 0
            assert len(t[q["piece_start"] : p["piece_end"]].encode()) <= overlap
        cuts, stretch, worst = set(units(t)[1]), 0, 0
        for j, c in enumerate(t):
            if j in cuts:
                stretch = 0
            stretch = 0 if c.isspace() else stretch + len(c.encode())
            worst = max(worst, stretch)
        assert flags[f"d{i}"] == int(worst > limit), i


def test_thinned_boundaries_keep_long_stretches():
    rng = random.Random(9)
    for _ in range(300):
        ends = sorted(rng.sample(range(400), rng.randrange(0, 25)))
        marks = np.array([(a, a + 1, a, a + 1, pieces.SPACE) for a in ends], np.int32).reshape(-1, 5)
        limit = rng.choice([5, 20, 60])
        gaps = lambda m: {(a, b) for a, b in zip(m[:-1, 3].tolist(), m[1:, 2].tolist(), strict=True) if b - a > limit}
        few = pieces.thinned(marks, limit)
        assert gaps(few) == gaps(marks) and len(few) <= len(marks)
        assert not ends or (few[0].tolist(), few[-1].tolist()) == (marks[0].tolist(), marks[-1].tolist())
