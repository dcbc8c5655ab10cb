"""Splitting oversized texts at natural boundaries (problem 6).

Texts above the limit are taken apart into ranges with halos around them (the chunks of ``sentences``). Workers list the
boundaries of their range: white space, forced places at code points inside long stretches without it, and the symbols
from which the ends of sentence units follow. One row per range comes together for a text: a prefix scan gives each
range its state, prefix sums of lengths turn offsets within a range into offsets within the text. Then each range
completes its boundary table with its ends of units. A text's tables run in order past a window of one limit, which
decides the cuts, and the pieces are emitted by offset from the ranges they touch. No step loads a whole text or its
whole boundary table.

A piece ends at the last sentence end that keeps it within the limit, else at the last white space, else at the last
forced place. The next piece starts at the earliest word within ``OVERLAP`` bytes before that end, so both share what
lies between (nothing where no word starts there); the shared length is given with the piece.

Edge cases: null, empty and small texts give nothing; rows without ``doc_id`` are left out; long white space
is cut inside like any other stretch; sizes are bytes in UTF-8.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltwork.llm.sentences import CHUNK, SCANNED, chunk_rows, pack, replayed, scan_chunk, unpack, with_states
from siltwork.session import stored

#: Largest size of a piece, largest overlap, both in bytes of UTF-8; characters of a range.
LIMIT, OVERLAP, RANGE = 2000, 200, CHUNK
FORCED, SPACE, SENTENCE = 0, 1, 2
#: White space as in Python's str.isspace.
_SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_IS_SPACE = np.zeros(0x3002, bool)
_IS_SPACE[_SPACES] = True


def ranges(docs: DataFrame, limit: int = LIMIT, size: int = RANGE) -> DataFrame:
    """Ranges of the texts above ``limit`` bytes, as rows of ``chunk_rows``."""
    return chunk_rows(docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") > limit)), size)


def byte_offsets(core: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points, and the byte each begins at, then the number of all bytes."""
    code = np.frombuffer(core.encode("utf-32-le", "surrogatepass"), np.uint32)
    return code, np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])


def spaces(core: str, code: np.ndarray, at: np.ndarray, every: int) -> np.ndarray:
    """Boundaries ``(end, next start, end byte, next start byte, kind)`` of a range but for the ends of units.

    White space, each long run of it in parts, and places in stretches of more than ``2 * every`` bytes without any.
    """
    white = _IS_SPACE[np.minimum(code, 0x3001)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], white, [False]]).astype(np.int8)))
    a, b = edge[::2], edge[1::2]
    if len(a) and (b - a).max() > every:
        a = np.concatenate([np.arange(x, y, every) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        b = np.minimum(a + every, b[np.searchsorted(edge[::2], a, "right") - 1])
    marks = np.stack([a, b, at[a], at[b], np.full(len(a), SPACE)], axis=1)
    begin, end = np.concatenate([[0], b]), np.concatenate([a, [len(code)]])
    forced = []
    for i in np.flatnonzero(at[end] - at[begin] > 2 * every).tolist():
        for target in range(int(at[begin[i]]) + every, int(at[end[i]]), every):
            c = int(np.searchsorted(at, target))
            while c < end[i] and unicodedata.combining(core[c]):
                c += 1
            if c < end[i]:
                forced.append((c, c, at[c], at[c], FORCED))
    if forced:
        marks = np.concatenate([marks, np.array(forced)])
        marks = marks[np.argsort(marks[:, 0], kind="stable")]
    return marks.astype(np.int32)


def thinned(marks: np.ndarray, limit: int) -> np.ndarray:
    """Natural boundaries without those between two others at most ``limit`` bytes apart, and the first and last."""
    natural = marks[marks[:, 4] > FORCED]
    if len(natural) < 3:
        return natural
    ends, starts = natural[:, 2].tolist(), natural[:, 3].tolist()
    kept = [0]
    for i in range(1, len(ends) - 1):
        if ends[i + 1] - starts[kept[-1]] > limit:
            kept.append(i)
    return natural[[*kept, len(ends) - 1]]


def with_units(marks: np.ndarray, ends: list[int], end_bytes: list[int]) -> np.ndarray:
    """``marks`` with the ends of units: those at white space are marked so, the others are added."""
    at = np.searchsorted(marks[:, 0], ends)
    there = at < len(marks)
    there[there] = marks[at[there], 0] == np.asarray(ends)[there]
    marks = marks.copy()
    marks[at[there], 4] = SENTENCE
    added = [(e, e, y, y, SENTENCE) for e, y, old in zip(ends, end_bytes, there.tolist(), strict=True) if not old]
    if added:
        marks = np.concatenate([marks, np.array(added, np.int32)])
        marks = marks[np.argsort(marks[:, 0], kind="stable")]
    return marks


def boundary_tables(rows: DataFrame, overlap: int = OVERLAP, limit: int | None = None) -> DataFrame:
    """``(doc_id, k, last, base, byte_base, n, bytes, first, until, inner, marks)`` of each range.

    ``first`` and ``until`` are the bytes where its first natural boundary ends a stretch and its last one begins one,
    ``inner`` the longest stretch between two of them. ``marks`` are its boundaries, offsets within it, packed. With a
    ``limit``, boundaries that make no difference to stretches above it are left out before anything is written.
    """
    every = max(1, overlap // 2)

    def first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, k, lo, hi, part, last in zip(*[b[c] for c in ("doc_id", "k", "lo", "hi", "part", "last")], strict=True):
                found, values = scan_chunk(part, lo, hi, k, last)
                core = part[lo:hi]
                code, at = byte_offsets(core)
                marks = spaces(core, code, at, every)
                # an end beyond the range belongs to a mark that the halo holds; its byte is the range's end
                end_bytes = at[np.minimum(found[1::3], len(code)).astype(int)] if found else ()
                out.append((d, k, last, *values, pack((thinned(marks, limit) if limit else marks).ravel()), pack(end_bytes)))
            yield pd.DataFrame(out, columns=["doc_id", "k", "last", "n", "bytes", "first", "until", "found", "f", "marks", "end_bytes"])

    def second_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                found, end_bytes = unpack(r.found), unpack(r.end_bytes)
                byte_of = dict(zip(found[1::3], end_bytes, strict=True))
                _, ends, _, _ = replayed(found, r.first, r.state, r.start, 0)
                marks = with_units(np.frombuffer(r.marks, "<i4").reshape(-1, 5), ends, [byte_of[e] for e in ends])
                natural = marks[marks[:, 4] > FORCED]
                if len(natural):
                    gaps = natural[1:, 2] - natural[:-1, 3]
                    edges = int(natural[0, 2]), int(natural[-1, 3]), int(gaps.max(initial=0))
                else:
                    edges = None, None, 0
                out.append((r.doc_id, r.k, r.last, r.base, r.byte_base, r.n, r.bytes, *edges, b"" if limit else pack(marks.ravel())))
            frame = pd.DataFrame(out, columns=["doc_id", "k", "last", "base", "byte_base", "n", "bytes", "first", "until", "inner", "marks"])
            yield frame.astype({"first": "Int64", "until": "Int64"})

    scanned = stored(rows.mapInPandas(first_pass, SCANNED + ", marks binary, end_bytes binary"), "ranges")
    schema = "doc_id string, k int, last boolean, base bigint, byte_base bigint, n int, bytes int, first int, until int, inner int, marks binary"
    return with_states(scanned).mapInPandas(second_pass, schema)


def oversized(tables: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(doc_id, unbroken)`` of every text with ranges; only the first and last boundary of a range leave it."""
    so_far = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("byte_base")
    edges = tables.select("doc_id", "k", "last", "inner", (begin + F.col("bytes")).alias("end"), (begin + F.col("first")).alias("first"), (begin + F.col("until")).alias("until"))
    edges = edges.withColumn("before", F.coalesce(F.max("until").over(so_far), F.lit(0).cast("long")))
    tail = F.when(F.col("last"), F.col("end") - F.greatest("before", F.coalesce("until", F.lit(0).cast("long"))))
    longest = F.greatest(F.coalesce("inner", F.lit(0)), F.coalesce(F.col("first") - F.col("before"), F.lit(0)), F.coalesce(tail, F.lit(0)))
    return edges.groupBy("doc_id").agg((F.max(longest) > limit).cast("int").alias("unbroken"))


class Cutter:
    """Decides the cuts of one text from its ranges in order; holds the boundaries within a limit and an overlap."""

    def __init__(self, limit: int, overlap: int) -> None:
        self.limit, self.overlap = limit, overlap
        self.kinds: dict[int, list[list[int]]] = {kind: [] for kind in (FORCED, SPACE, SENTENCE)}
        self.natural: list[list[int]] = []
        self.bases: list[tuple[int, int]] = []  # first character and number of ranges
        self.seen = self.n = self.start = self.start_byte = self.end = self.end_byte = 0

    def feed(self, k: int, base: int, byte_base: int, n: int, size: int, marks: np.ndarray) -> Iterator[tuple]:
        """Take the next range; pieces ``(start, end, bytes, shared characters, kind, first range, last range)`` that are decided."""
        self.bases.append((base, k))
        for a, b, x, y, kind in marks.tolist():
            mark = [a + base, b + base, x + byte_base, y + byte_base]
            self.kinds[kind].append(mark)
            if kind > FORCED:
                self.natural.append(mark)
        self.seen, self.n = byte_base + size, base + n
        while self.seen - self.start_byte > self.limit:
            yield self._cut()

    def finish(self) -> Iterator[tuple]:
        """The last piece."""
        yield (self.start, self.n, self.seen - self.start_byte, max(0, self.end - self.start), -1, *self._ranges(self.start, self.n))

    def _ranges(self, start: int, end: int) -> tuple[int, int]:
        last = lambda c: self.bases[bisect_right(self.bases, c, key=lambda x: x[0]) - 1][1]
        return last(start), last(max(start, end - 1))

    def _cut(self) -> tuple:
        for kind in (SENTENCE, SPACE, FORCED):
            marks = self.kinds[kind]
            i = bisect_right(marks, self.start_byte + self.limit, key=lambda m: m[2]) - 1
            if i >= 0 and marks[i][2] > self.end_byte:
                end, after, end_byte, after_byte = marks[i]
                break
        else:  # cannot happen while forced places are closer than the limit
            raise ValueError(f"no place to cut after byte {self.start_byte}")
        piece = (self.start, end, end_byte - self.start_byte, max(0, self.end - self.start), kind, *self._ranges(self.start, end))
        least = max(end_byte - self.overlap, self.start_byte + 1)
        start, start_byte = after, after_byte
        for starts in (self.natural, self.kinds[FORCED]):
            i = bisect_left(starts, least, key=lambda m: m[3])
            if i < len(starts) and starts[i][3] < end_byte:
                start, start_byte = starts[i][1], starts[i][3]
                break
        self.start, self.start_byte, self.end, self.end_byte = start, start_byte, end, end_byte
        for marks in (*self.kinds.values(), self.natural):
            del marks[: bisect_left(marks, start_byte, key=lambda m: m[2])]
        del self.bases[: bisect_right(self.bases, start, key=lambda x: x[0]) - 1]
        return piece


def piece_spans(tables: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, piece, piece_start, piece_end, n_bytes, shared, cut, k0, k1)``; the piece lies in ranges k0 to k1."""
    if not 0 <= overlap * 2 < limit:
        raise ValueError("the overlap must be less than half the limit")
    names = {FORCED: "forced", SPACE: "space", SENTENCE: "sentence", -1: "end"}
    columns = ["doc_id", "piece", "piece_start", "piece_end", "n_bytes", "shared", "cut", "k0", "k1"]

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, piece, cutter = None, 0, Cutter(limit, overlap)
        for batch in batches:
            out = []

            def emit(pieces: Iterator[tuple], out: list = out) -> None:
                nonlocal piece
                for s, e, n, shared, kind, k0, k1 in pieces:
                    out.append((doc, piece, s, e, n, shared, names[kind], k0, k1))
                    piece += 1

            for r in batch.itertuples(index=False):
                if r.doc_id != doc:
                    doc, piece, cutter = r.doc_id, 0, Cutter(limit, overlap)
                emit(cutter.feed(r.k, r.base, r.byte_base, r.n, r.bytes, np.frombuffer(r.marks, "<i4").reshape(-1, 5)))
                if r.last:
                    emit(cutter.finish())
            yield pd.DataFrame(out, columns=columns)

    # the ranges of a text come in order, a batch at a time
    ordered = tables.select("doc_id", "k", "last", "base", "byte_base", "n", "bytes", "marks").repartition("doc_id").sortWithinPartitions("doc_id", "k")
    return ordered.mapInPandas(cuts, "doc_id string, piece int, piece_start int, piece_end int, n_bytes int, shared int, cut string, k0 int, k1 int")


def pieces(rows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, piece, piece_start, piece_end, n_bytes, shared, cut, text)``: pieces put together from their ranges."""
    tables = stored(boundary_tables(rows, overlap), "boundaries")
    touched = piece_spans(tables, limit, overlap).withColumn("k", F.explode(F.sequence("k0", "k1")))
    core = rows.select("doc_id", "k", F.substr("part", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("core"))
    joined = touched.join(core, ["doc_id", "k"]).join(tables.select("doc_id", "k", "base", "n"), ["doc_id", "k"])
    a = F.greatest(F.col("piece_start") - F.col("base"), F.lit(0))
    z = F.least(F.col("piece_end") - F.col("base"), F.col("n"))
    keys = ["doc_id", "piece", "piece_start", "piece_end", "n_bytes", "shared", "cut"]
    return (
        joined.select(*keys, "k", F.substr("core", (a + 1).cast("int"), (z - a).cast("int")).alias("t"))
        .groupBy(*keys)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "").alias("text"))
    )
