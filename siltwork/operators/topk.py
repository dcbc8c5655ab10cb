"""The best documents of many queries at once, without a row for each pair of a query and a document.

A task scores its documents, some at a time, against a whole block of queries in one array, and keeps ``k`` documents a
query, so what leaves it grows with queries and tasks, not with queries times documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bounds of memory: scores held at once, products of weights expanded at once, candidates that wait for a cut.
CELLS, EXPANDED, WAITING = 1 << 20, 1 << 20, 1 << 19
#: A term with so many products per array of scores is added by itself.
HEAVY = 8192


@dataclass
class Block:
    """Weighted terms of some queries: those of term t are ``query[ptr[t]:ptr[t + 1]]``; light terms come first."""

    query_ids: pa.Array
    terms: pa.Array
    ptr: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    n_light: int
    width: int

    @classmethod
    def of(cls, rows: pa.Table, n_docs: int) -> Block:
        """Of ``(query_id, term, df, qw)``. The order of terms is the same for all documents, so equal ones score equally."""
        queries, terms = (_encoded(rows.column(c)) for c in ("query_id", "term"))
        ids, names = terms.indices.to_numpy(zero_copy_only=False), terms.dictionary
        width = int(np.clip(CELLS // max(1, len(queries.dictionary)), 16, 8192))
        df = np.zeros(len(names))
        df[ids] = rows.column("df").to_numpy()
        heavy = np.bincount(ids, minlength=len(names)) * df * (width / max(1, n_docs)) >= HEAVY
        by_name = np.argsort(pc.sort_indices(names).to_numpy())
        order = np.lexsort((by_name, heavy))
        ids = np.argsort(order)[ids]
        query = queries.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.lexsort((query, ids))
        ptr = np.searchsorted(ids[at], np.arange(len(names) + 1))
        return cls(queries.dictionary, names.take(pa.array(order)), ptr, query[at], rows.column("qw").to_numpy()[at], int((~heavy).sum()), width)


def _encoded(column: pa.ChunkedArray) -> pa.DictionaryArray:
    return pa.concat_arrays(column.chunks or [pa.array([], column.type)]).dictionary_encode()


class Best:
    """Candidates by query; ``cut`` leaves the ``k`` best of each, of equal scores those with the greatest ids."""

    def __init__(self, n_queries: int, k: int, id_type: pa.DataType) -> None:
        self.n, self.k, self.most = n_queries, k, max(WAITING, n_queries * k)
        self.least = np.full(n_queries, np.nextafter(0.0, 1.0))
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.ids, self.n_ids, self.waiting = [pa.array([], id_type)], 0, 0

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores, a row per document, a column per query; and the documents' ids."""
        cells = np.flatnonzero(scores >= self.least)
        doc = cells // self.n
        self.parts.append(((cells - doc * self.n).astype(np.int32), scores.ravel()[cells], (doc + self.n_ids).astype(np.int32)))
        self.ids.append(ids)
        self.n_ids += len(ids)
        self.waiting += len(cells)
        if self.waiting > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """``(query, score, id)`` of what is left."""
        query, score, doc = (np.concatenate([p[i] for p in self.parts] or [np.empty(0, t)]) for i, t in enumerate((np.int32, float, np.int32)))
        at = np.argsort(-score)
        at = at[np.argsort(query[at].astype(np.min_scalar_type(self.n)), kind="stable")]
        query, score, doc = query[at], score[at], doc[at]
        ids = pa.concat_arrays(self.ids)
        start = np.searchsorted(query, np.arange(self.n + 1))
        full = np.flatnonzero(np.diff(start) >= self.k)
        self.least[full] = score[start[full] + self.k - 1]
        more = full[np.diff(start)[full] > self.k]
        tied = np.zeros(self.n, bool)
        tied[more] = score[start[more] + self.k] == self.least[more]
        run = np.flatnonzero(tied[query] & (score == self.least[query]))
        if len(run):
            rows = pa.table({"query": query[run], "id": ids.take(pa.array(doc[run]))})
            doc[run] = doc[run][pc.sort_indices(rows, [("query", "ascending"), ("id", "descending")]).to_numpy()]
        left = np.arange(len(query)) - start[query] < self.k
        query, score, doc = query[left], score[left], doc[left]
        used, doc = np.unique(doc, return_inverse=True)
        self.ids, self.n_ids = [ids.take(pa.array(used))], len(used)
        self.parts, self.waiting = [(query, score, doc.astype(np.int32))], 0
        return query, score, self.ids[0].take(pa.array(doc))


def scored(block: Block, term: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores of ``n_docs`` documents by the block's queries, of term weights sorted by term."""
    n = len(block.query_ids)
    out = np.zeros(n_docs * n)
    at = np.searchsorted(term, block.n_light)
    each = block.ptr[term[:at] + 1] - block.ptr[term[:at]]
    upto = np.concatenate([[0], np.cumsum(each)])
    a = 0
    while a < at:  # as many as EXPANDED allows, one at least
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + EXPANDED, side="right")) - 1)
        inside = np.arange(upto[b] - upto[a]) + np.repeat(block.ptr[term[a:b]] - (upto[a:b] - upto[a]), each[a:b])
        np.add.at(out, np.repeat(doc[a:b] * n, each[a:b]) + block.query[inside], np.repeat(weight[a:b], each[a:b]) * block.weight[inside])
        a = b
    for t in np.unique(term[at:]):
        a, b = np.searchsorted(term, [t, t + 1])
        of = slice(block.ptr[t], block.ptr[t + 1])
        out[(doc[a:b] * n)[:, None] + block.query[of]] += weight[a:b, None] * block.weight[of]
    return out.reshape(n_docs, n)


def best(batches: Iterator[pa.RecordBatch], block: Block, k: int) -> Iterator[pa.RecordBatch]:
    """``(query_id, doc_id, score)``: the ``k`` best of the documents ``(doc_id, terms)`` for each query of the block."""
    found = None
    for batch in batches:
        if not len(block.query_ids) or not batch.num_rows:
            continue
        ids, lists = batch.column("doc_id"), batch.column("terms")
        found = found or Best(len(block.query_ids), k, ids.type)
        names, tf = lists.flatten().flatten()
        tf, n_terms = tf.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(ids)), n_terms)
        ordered = np.sort(doc << 32 | np.minimum(tf, (1 << 32) - 1)) & ((1 << 32) - 1)  # squares are summed up in one order
        norm = np.sqrt(np.add.reduceat((1 + np.log2(ordered)) ** 2, np.cumsum(n_terms) - n_terms))
        term = pc.fill_null(pc.index_in(names, value_set=block.terms), -1).to_numpy(zero_copy_only=False)
        held = np.flatnonzero(term >= 0)
        term, doc, weight = term[held], doc[held], (1 + np.log2(tf[held])) / norm[doc[held]]
        cuts = [*range(0, len(ids), block.width), len(ids)]
        places = np.searchsorted(doc, cuts)
        for lo, hi, a, b in zip(cuts, cuts[1:], places, places[1:], strict=False):
            at = a + np.argsort(term[a:b], kind="stable")
            found.add(scored(block, term[at], doc[at] - lo, weight[at], hi - lo), ids.slice(lo, hi - lo))
    if found:
        query, score, ids = found.cut()
        out = pa.RecordBatch.from_arrays([block.query_ids.take(pa.array(query)), ids, pa.array(score)], ["query_id", "doc_id", "score"])
        for at in range(0, len(out), 1 << 16):
            yield out.slice(at, 1 << 16)
