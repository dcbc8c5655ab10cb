"""Encoding with a public byte-level BPE vocabulary (problem 8).

A text is cut into pre-tokens by the vocabulary's pattern. A pre-token that is no token itself is merged with a queue
over merge ranks: each rank has a bucket of linked-list positions, a hierarchical bitmap of 64-bit words marks the
buckets that are not empty, find-first-set picks the least rank, and entries whose pair has changed since are skipped.
A merge costs O(log) of its bucket whatever the length, so pre-tokens of a million characters are no problem.

Each Python worker keeps the ids of the pre-tokens it has met in a cache of bounded size.

Edge cases: null and empty texts give an empty list; strings that look like special tokens are ordinary text;
unpaired surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every function that needs it.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens kept per worker, and the longest that are kept: at most some 100 MB.
CACHE_SIZE, CACHE_LENGTH = 400_000, 64
#: Fixed value: the vocabulary's pattern. White space is spelled out, as regex and the vocabulary's own library differ.
SPACE = r"\t\n\x0b\f\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


class RankBitmap:
    """Set of ranks with find-first-set: each level has one bit for every non-zero 64-bit word of the level below."""

    def __init__(self, size: int) -> None:
        self.levels = []
        while True:
            size = (size + 63) >> 6
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, i: int) -> None:
        for words in self.levels:
            w = i >> 6
            before = words[w]
            words[w] = before | 1 << (i & 63)
            if before:
                break
            i = w

    def remove(self, i: int) -> None:
        for words in self.levels:
            w = i >> 6
            words[w] &= ~(1 << (i & 63))
            if words[w]:
                break
            i = w

    def first(self) -> int:
        """The least member, or -1."""
        if not self.levels[-1][0]:
            return -1
        i = 0
        for words in reversed(self.levels):
            word = words[i]
            i = i << 6 | (word & -word).bit_length() - 1
        return i


class ByteBpe:
    """Encoder of one vocabulary, given as lines of base64 token and rank."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.size = max(self.ranks.values()) + 1
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}
        self.queue = RankBitmap(self.size)
        self.buckets: dict[int, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: always the least rank next, leftmost first."""
        ranks, queue, buckets = self.ranks, self.queue, self.buckets
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        token = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n  # rank of the pair that starts here, -1 for none

        def offer(i: int) -> None:
            j = after[i]
            rank = ranks.get(token[i] + token[j], -1) if j < n else -1
            pair[i] = rank
            if rank >= 0:
                bucket = buckets.get(rank)
                if bucket:
                    heappush(bucket, i)
                else:
                    buckets[rank] = [i]
                    queue.add(rank)

        for i in range(n - 1):
            offer(i)
        while (rank := queue.first()) >= 0:
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                queue.remove(rank)
            if pair[i] != rank or not token[i]:
                continue  # stale
            j = after[i]
            token[i] += token[j]
            token[j], pair[j] = b"", -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        buckets.clear()
        out, i = [], 0
        while i < n:
            out.append(ranks[token[i]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        cache, extend = self.cache, out.extend
        for word in self.find(text):
            ids = cache.get(word)
            if ids is None:
                ids = self.merge(word.encode())
                if len(word) <= CACHE_LENGTH:
                    if len(cache) >= CACHE_SIZE:
                        cache.clear()
                    cache[word] = ids
            extend(ids)
        return out


_loaded: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """The encoder of a vocabulary file, loaded once per process."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def ids_of(text: Column, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    """``array<int>``: ids of a text."""
    path = os.path.join(folder, name)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode_one = encoder(path).encode
        for texts in batches:
            yield pd.Series([encode_one(x) for x in texts], dtype=object)

    return encode(text)


def n_tokens_of(text: Column, folder: str = TOKENIZERS, name: str = VOCABULARY) -> Column:
    """``int``: number of tokens of a text; only the number leaves the worker."""
    path = os.path.join(folder, name)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode_one = encoder(path).encode
        for texts in batches:
            yield pd.Series([len(encode_one(x)) for x in texts], dtype="int32")

    return count(text)
