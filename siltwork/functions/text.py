"""Text functions as Column expressions. Null in, null out, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters between tokens, without and with white space other than the blank.
STRICT = " ,.:;\"'"
WHITESPACE = STRICT + "\t\n\x0b\f\r"
#: Words that carry no meaning of their own in English.
STOP_WORDS = """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself
it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having
do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from
up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't
hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't""".split()


def ascii_lower(text: Column) -> Column:
    """Characters outside ASCII dropped (they do not split words), then lower case."""
    return F.lower(F.regexp_replace(text, r"[^\x00-\x7F]", ""))


def analyze(text: Column, delims: str = STRICT) -> Column:
    """Tokens of a text: ``ascii_lower``, cut at ``delims``, empty ones dropped. A null text has no tokens."""
    cut = "[" + "".join(f"\\x{ord(c):02x}" for c in delims) + "]"
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), cut), lambda x: x != "")


def marked(word: Column) -> Column:
    """A word with its boundary, a blank before it."""
    return F.concat(F.lit(" "), word)


def shown(token: Column) -> Column:
    """Boundary mark as it is shown in a vocabulary: a leading blank becomes Ġ."""
    return F.regexp_replace(token, "^ ", "Ġ")


def continuation(token: Column, initial: Column) -> Column:
    """Word piece as it is shown: pieces inside a word begin with ##."""
    return F.when(initial, F.regexp_replace(token, "^ ", "")).otherwise(F.concat(F.lit("##"), token))


def is_alnum(token: Column) -> Column:
    """ASCII letters and digits, after at most one blank."""
    return token.rlike("^ ?[A-Za-z0-9]+$")


def piece_score(pair: Column, left: Column, left_alnum: Column, right: Column, right_alnum: Column) -> Column:
    """Word piece score of a pair: its frequency over those of its parts, roots of which count for letters and digits."""
    part = lambda f, a: F.when(a, F.sqrt(f.cast("double"))).otherwise(f.cast("double"))
    return pair.cast("double") / part(left, left_alnum) / part(right, right_alnum)


#: Characters of a word, and white space, the same in any regular expression engine.
WORD_CHAR, SPACE = r"\p{L}\p{M}\p{N}_", r"\s\x0B\x85\p{Z}"
CLITIC = "n't|'s|'re|'ve|'ll|'d|'m"


def collapse(text: Column) -> Column:
    """Each run of white space one blank, none outside."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def words(text: Column) -> Column:
    """Parts between white space; a null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda x: x != "")


def word_tokens(text: Column) -> Column:
    """Linguistic tokens by rule: words with inner hyphens or points, English clitics apart, other marks alone."""
    apart = F.regexp_replace(F.coalesce(text, F.lit("")), f"({CLITIC})([^{WORD_CHAR}]|$)", " $1 $2")
    return F.regexp_extract_all(apart, F.lit(f"{CLITIC}|[{WORD_CHAR}]+(?:[-.][{WORD_CHAR}]+)*|[^{SPACE}{WORD_CHAR}]"), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts between a point and a blank; an empty text is one empty sentence."""
    return F.split(text, r"\. ")


def chunks(text: Column, size: int = 3) -> Column:
    """Passages of ``size`` sentences without overlap, the empty ones dropped."""
    s = sentences(text)
    starts = F.sequence(F.lit(0), F.size(s) - 1, F.lit(size))
    return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(s, i + 1, size), ". ")), lambda x: x != "")


def first_sentences(text: Column, n: int = 3) -> Column:
    """The first ``n`` sentences."""
    return F.array_join(F.slice(sentences(text), 1, n), ". ")


def without_stop_words(tokens: Column) -> Column:
    """Tokens without stop words, repeats kept."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(tokens, lambda x: ~F.array_contains(stop, x))


def lemma_rule(token: Column) -> Column:
    """Base form of an English noun by suffix: the rule that a lemma map stands in for."""
    rules = [("ies$", "y"), ("(s|x|z|ch|sh)es$", "$1"), ("men$", "man"), ("ves$", "f")]
    out = F.when(token.rlike("[^s]s$") & ~token.rlike("(us|is)$"), F.regexp_replace(token, "s$", "")).otherwise(token)
    for pattern, to in reversed(rules):
        out = F.when(token.rlike(pattern), F.regexp_replace(token, pattern, to)).otherwise(out)
    return F.when(F.length(token) > 3, out).otherwise(token)


def preprocess(text: Column, lemma=None) -> Column:
    """Lower case, white space collapsed, tokens, no stop words, lemmas if a function for them is given, letters only."""
    tokens = without_stop_words(word_tokens(collapse(F.lower(text))))
    if lemma is not None:
        tokens = F.transform(tokens, lemma)
    return F.filter(tokens, lambda x: x.rlike(r"^\p{L}+$"))


def preprocess_with_table(texts: DataFrame, lemmas: DataFrame) -> DataFrame:
    """``texts`` (doc_id, text; unique ids) as ``(doc_id, tokens)``: as ``preprocess``, base forms out of ``lemmas``
    (token, lemma; unique tokens). A token without one stays as it is. Texts without tokens have an empty array."""
    tokens = texts.select("doc_id", without_stop_words(word_tokens(collapse(lower_text(F.col("text"))))).alias("t"))
    each = tokens.select("doc_id", F.posexplode("t").alias("at", "token")).join(lemmas, "token", "left")
    kept = each.withColumn("token", F.coalesce("lemma", "token")).where(F.col("token").rlike(r"^\p{L}+$"))
    lists = kept.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("tokens"))
    return texts.select("doc_id").join(lists, "doc_id", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))


def lower_text(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def expand_query(query: Column, passage_tokens: Column, times: int = 5, preprocessed: bool = False) -> Column:
    """The query ``times`` over, a blank after each, then the tokens of a generated passage.

    The query stays as it is, so its capitals match no document in small letters, unless it is to be ``preprocessed``.
    """
    if preprocessed:
        query = F.array_join(preprocess(query, lemma_rule), " ")
    return F.concat(F.repeat(F.concat(query, F.lit(" ")), times), F.array_join(passage_tokens, " "))


def clean_generated(text: Column) -> Column:
    """Runs of line feeds, then tabs, then blanks become one blank."""
    for run in ("\\n+", "\\t+", " +"):
        text = F.regexp_replace(text, run, " ")
    return text


def escape_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def prompt(examples: Column, query: Column) -> Column:
    """Blocks of examples (an array of query and passage), then the query with an open passage."""
    block = lambda e: F.concat(F.lit("Example Query: "), e["query"], F.lit("\nExample Passage: "), e["passage"], F.lit("\n\n"))
    return F.concat(F.array_join(F.transform(examples, block), ""), F.lit("Query: "), query, F.lit("\nPassage: "))


def tf_weight(tf: Column) -> Column:
    return 1.0 + F.log2(tf.cast("double"))


def idf_weight(n: Column, df: Column) -> Column:
    return F.log2(1.0 + n.cast("double") / df.cast("double"))
