"""Vocabularies learned from a corpus (words, byte pairs, word pieces) and encoding with them.

Words and their frequencies are counted in Spark. Learning is sequential by nature: up to ``DRIVER_WORDS`` distinct
words it runs on the driver over these counts; beyond, the words stay distributed, each merge is one aggregate of pair
frequencies (at most size x size rows) and one pass over the words. Both give the same vocabulary.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions.text import analyze, is_alnum, marked, piece_score
from siltwork.operators.ordering import with_place
from siltwork.session import stored

BPE_SIZE, PIECE_SIZE = 300, 500
#: Distinct words that may come to the driver: 250 MB, as measured for words of nine symbols.
DRIVER_WORDS = 300_000
UNKNOWN = "UNK"


def train_entries(docs: DataFrame, fraction: float = 0.5) -> DataFrame:
    """``(pos, text)``: the first ``fraction`` of the entries title, abstract, title, ... in the order of ``line_no``.

    The place of a row is counted over ranges of line numbers, so the order needs no single task.
    """
    placed = with_place(docs.select("line_no", "title", "abstract"), ["line_no"])
    n_entries = int(2 * docs.count() * fraction)
    entry = F.posexplode(F.array(F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))).alias("side", "text")
    entries = placed.where(F.col("place") * 2 < n_entries).select("place", entry)
    return entries.select((F.col("place") * 2 + F.col("side")).alias("pos"), "text").where(F.col("pos") < n_entries)


def word_frequencies(texts: DataFrame) -> DataFrame:
    """``(term, freq)`` over a column ``text``."""
    return texts.select(F.explode(analyze(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def pair_frequencies(words: DataFrame) -> DataFrame:
    """``(left, right, freq)`` of adjacent characters of words with their boundary, weighted by word frequency."""
    chars = F.split(marked(F.col("term")), "")
    pairs = F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.struct(F.element_at(chars, i).alias("left"), F.element_at(chars, i + 1).alias("right")))
    return words.select("freq", F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.sum("freq").alias("freq"))


def piece_symbols(term: Column) -> Column:
    """Symbols of a word before learning: its first character marked as initial, the others as they are."""
    chars = F.split(term, "")
    return F.transform(chars, lambda c, i: F.when(i == 0, marked(c)).otherwise(c))


def piece_pair_scores(words: DataFrame) -> DataFrame:
    """``(left, right, freq, score)`` of adjacent symbols before learning; words of one character do not count."""
    counted = words.where(F.length("term") > 1).select("freq", piece_symbols(F.col("term")).alias("s"))
    single = counted.select("freq", F.explode("s").alias("t")).groupBy("t").agg(F.sum("freq").alias("f"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct(F.element_at("s", i).alias("left"), F.element_at("s", i + 1).alias("right")))
    freq = counted.select("freq", F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.sum("freq").alias("freq"))
    left, right = single.select(F.col("t").alias("left"), F.col("f").alias("fl")), single.select(F.col("t").alias("right"), F.col("f").alias("fr"))
    joined = freq.join(left, "left").join(right, "right")
    score = piece_score(F.col("freq"), F.col("fl"), is_alnum(F.col("left")), F.col("fr"), is_alnum(F.col("right")))
    return joined.select("left", "right", "freq", score.alias("score"))


@dataclass
class Vocabulary:
    """Tokens by id and the merges that made them: rank, left id, right id, merged id."""

    kind: str
    tokens: list[str]
    merges: list[tuple[int, int, int]] = field(default_factory=list)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """``(token_id, token)`` and ``(rank, left_id, right_id, merged_id)``."""
        tokens = spark.createDataFrame(list(enumerate(self.tokens)), "token_id int, token string")
        return tokens, spark.createDataFrame([(i, *m) for i, m in enumerate(self.merges)], "rank int, left_id int, right_id int, merged_id int")

    def save(self, spark: SparkSession, path: str) -> None:
        tokens, merges = self.tables(spark)
        tokens.coalesce(1).write.mode("overwrite").parquet(f"{path}/tokens")
        merges.coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
        spark.createDataFrame([(self.kind,)], "kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/kind")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Vocabulary:
        kind = spark.read.parquet(f"{path}/kind").first()["kind"]
        tokens = [r["token"] for r in spark.read.parquet(f"{path}/tokens").orderBy("token_id").collect()]
        merges = [tuple(r)[1:] for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
        return cls(kind, tokens, merges)


def _joined(symbols: list[int], left: int, right: int, new: int) -> list[int]:
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and symbols[i] == left and symbols[i + 1] == right:
            out.append(new)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def _alnum(token: str) -> bool:
    body = token[1:] if token[:1] == " " else token
    return bool(body) and body.isascii() and body.isalnum()


class _Learner:
    """Pair and token frequencies of a set of words, kept up to date by the words a merge touches."""

    def __init__(self, words: list[list[int]], freqs: list[int]) -> None:
        self.words, self.freqs = words, freqs
        self.pairs: Counter = Counter()
        self.single: Counter = Counter()
        self.where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for w in range(len(words)):
            self._add(w, 1)

    def _add(self, w: int, sign: int) -> None:
        symbols, f = self.words[w], self.freqs[w] * sign
        for s in symbols:
            self.single[s] += f
        for p in zip(symbols, symbols[1:], strict=False):
            self.pairs[p] += f
            if sign > 0:
                self.where[p].add(w)

    def counts(self) -> tuple[Counter, Counter]:
        return self.pairs, self.single

    def merge(self, left: int, right: int, new: int) -> None:
        for w in self.where.pop((left, right), set()):
            changed = _joined(self.words[w], left, right, new)
            if len(changed) != len(self.words[w]):
                self._add(w, -1)
                self.words[w] = changed
                self._add(w, 1)


class _SparkLearner:
    """The same over a table of words ``(symbols array<int>, freq)`` that stays distributed."""

    def __init__(self, words: DataFrame) -> None:
        self.words = stored(words, "words")
        self.done = 0

    def counts(self) -> tuple[Counter, Counter]:
        s = F.col("symbols")
        pairs = F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.struct(F.element_at(s, i).alias("l"), F.element_at(s, i + 1).alias("r")))
        rows = self.words.where(F.size(s) > 1).select("freq", F.explode(pairs).alias("p")).groupBy("p.l", "p.r").agg(F.sum("freq").alias("f")).collect()
        single = self.words.select("freq", F.explode(s).alias("t")).groupBy("t").agg(F.sum("freq").alias("f")).collect()
        return Counter({(r[0], r[1]): r[2] for r in rows}), Counter({r[0]: r[1] for r in single})

    def merge(self, left: int, right: int, new: int) -> None:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(symbols=[_joined(list(s), left, right, new) for s in b["symbols"]])

        self.words = stored(self.words.mapInPandas(run, "symbols array<int>, freq bigint"), "words")


def _learn(words: DataFrame, kind: str, size: int, driver_words: int) -> Vocabulary:
    """Merge the best pair until there are ``size`` tokens or no pair has a positive frequency.

    Best is the most frequent pair for bpe, the one of the highest score for pieces; ties go to the greater ids.
    """
    if kind == "bpe":
        tokens = [chr(i) for i in range(128)]
        symbols = F.transform(F.split(marked(F.col("term")), ""), lambda c: F.ascii(c))
        table = words.select(symbols.alias("symbols"), "freq")
    else:
        tokens = [x for i in range(128) for x in (chr(i), " " + chr(i))]
        symbols = F.transform(F.split("term", ""), lambda c, i: F.ascii(c) * 2 + F.when(i == 0, 1).otherwise(0))
        table = words.where(F.length("term") > 1).select(symbols.alias("symbols"), "freq")
    table = stored(table, "words")
    if table.count() <= driver_words:
        rows = table.collect()
        learner: _Learner | _SparkLearner = _Learner([list(r[0]) for r in rows], [r[1] for r in rows])
    else:
        learner = _SparkLearner(table)
    merges: list[tuple[int, int, int]] = []
    weight = lambda t, f: f**0.5 if _alnum(tokens[t]) else f
    while len(tokens) < size:
        pairs, single = learner.counts()
        live = ((p, f) for p, f in pairs.items() if f > 0)
        if kind == "bpe":
            best = max(((f, p) for p, f in live), default=None)
        else:
            best = max(((f / weight(p[0], single[p[0]]) / weight(p[1], single[p[1]]), p) for p, f in live), default=None)
        if best is None:
            break
        left, right = best[1]
        merges.append((left, right, len(tokens)))
        tokens.append(tokens[left] + tokens[right])
        learner.merge(left, right, len(tokens) - 1)
    return Vocabulary(kind, tokens, merges)


def learn_simple(docs: DataFrame) -> DataFrame:
    """``(term)``: the distinct words of ``text``, and the unknown token."""
    words = docs.select(F.explode(analyze(F.col("text"))).alias("term")).distinct()
    return words.unionByName(docs.sparkSession.createDataFrame([(UNKNOWN,)], "term string"))


def learn_bpe(words: DataFrame, size: int = BPE_SIZE, driver_words: int = DRIVER_WORDS) -> Vocabulary:
    return _learn(words, "bpe", size, driver_words)


def learn_pieces(words: DataFrame, size: int = PIECE_SIZE, driver_words: int = DRIVER_WORDS) -> Vocabulary:
    return _learn(words, "wordpiece", size, driver_words)


class BpeEncoder:
    """Applies the merge of the lowest rank, leftmost first, until none is left."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.rank = {(a, b): (i, m) for i, (a, b, m) in enumerate(vocabulary.merges)}

    def __call__(self, word: str) -> list[int]:
        symbols = [ord(c) for c in " " + word]
        while len(symbols) > 1:
            best = min((self.rank[p] + (p,) for p in zip(symbols, symbols[1:], strict=False) if p in self.rank), default=None)
            if best is None:
                break
            symbols = _joined(symbols, *best[2], best[1])
        return symbols


class PieceEncoder:
    """Greedy longest match; what matches nothing is unknown, one character at a time."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.ids: dict[str, int] = {}
        for i, t in enumerate(vocabulary.tokens):
            self.ids.setdefault(t, i)
        self.longest = max(map(len, vocabulary.tokens))
        self.unknown = len(vocabulary.tokens)

    def __call__(self, word: str) -> list[int]:
        text, at, out = " " + word, 0, []
        while at < len(text):
            for end in range(min(len(text), at + self.longest), at, -1):
                piece = text[at:end]
                if piece in self.ids and not (at == 0 and piece == " "):
                    out.append(self.ids[piece])
                    at = end
                    break
            else:
                out.append(self.unknown)
                at += 2 if at == 0 else 1
        return out


def encoder(vocabulary: Vocabulary):
    """Arrow function from an array of words to ``array<int>``; each worker keeps the words it has met."""
    make = {"bpe": BpeEncoder, "wordpiece": PieceEncoder}[vocabulary.kind]

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one, known = make(vocabulary), {}
        for batch in batches:
            out = []
            for words in batch:
                ids: list[int] = []
                for w in words if words is not None else ():
                    got = known.get(w)
                    if got is None:
                        if len(known) > 500_000:
                            known.clear()
                        got = known[w] = one(w)
                    ids += got
                out.append(ids)
            yield pd.Series(out, dtype=object)

    return run


def encode(tokens: Column, vocabulary: Vocabulary) -> Column:
    """``array<int>`` of an array of words."""
    return encoder(vocabulary)(tokens)


def unknown_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``tokens`` (..., term) with ``known``: whether the vocabulary ``(term)`` has it; the others stand for unknown."""
    return tokens.join(vocabulary.select("term", F.lit(True).alias("known")), "term", "left").withColumn("known", F.coalesce("known", F.lit(False)))
