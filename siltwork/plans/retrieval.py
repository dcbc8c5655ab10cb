"""Queries of retrieval, query expansion and evaluation, and their SQL.

Tables: ``cord19_trec_covid_docs`` is the collection that is searched, its first row per id counts. ``docs_file`` (latest
row per id) with ``qrels_file`` (last row per pair) gives relevant documents, ``queries_file`` (latest row per id) the
queries; searches and tests take those whose id is divisible by 100, all others are for examples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.functions import registry
from siltwork.functions import text as T
from siltwork.operators import dedup, fewshot, index, passages, rerank, search, vocabularies
from siltwork.session import stored
from siltwork.sources.tables import current_rows, id_key, is_blank, table

TOP = 100
TOP_DOCS = 20


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, line_no, title, abstract, text)`` of the collection."""
    first = dedup.pick(table(spark, folder, "cord19_trec_covid_docs").select("line_no", "doc_id", "title", "abstract"), id_key("doc_id"), F.col("line_no"), as_key="doc_id")
    joined = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("abstract", F.lit("")))
    return first.select("doc_id", "line_no", "title", "abstract", joined.alias("text"))


def queries_of(spark: SparkSession, folder: str) -> DataFrame:
    """``(query_id, title, text, test)`` of all queries."""
    rows = current_rows(table(spark, folder, "queries_file"), "query_id", "loaded_at", ["title", "description", "narrative"])
    test = F.coalesce(F.try_to_number("query_id", F.lit("999999999999999999")) % 100 == 0, F.lit(False))
    return rows.select("query_id", F.coalesce("title", F.lit("")).alias("title"), F.concat_ws(" ", "title", "description", "narrative").alias("text"), test.alias("test"))


def tests_of(spark: SparkSession, folder: str) -> DataFrame:
    return queries_of(spark, folder).where("test")


def docs_of(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, text)`` of ``docs_file``."""
    return current_rows(table(spark, folder, "docs_file"), "doc_id", "loaded_at", ["text"]).select(id_key("doc_id").alias("doc_id"), "text")


def qrels_of(spark: SparkSession, folder: str) -> DataFrame:
    """``(query_id, doc_id, rel, pos)``: the last row of each pair; rows without ids or relevance do not count."""
    rows = table(spark, folder, "qrels_file").where(F.col("rel").isNotNull() & ~is_blank("query_id") & ~is_blank("doc_id"))
    keyed = rows.select(id_key("query_id").alias("query_id"), id_key("doc_id").alias("doc_id"), "rel", "line_no")
    return keyed.groupBy("query_id", "doc_id").agg(F.max(F.struct("line_no", "rel")).alias("r")).select("query_id", "doc_id", "r.rel", F.col("r.line_no").alias("pos"))


def top_docs_of(spark: SparkSession, folder: str, n: int = TOP_DOCS) -> DataFrame:
    """``(query_id, top_docs)``: the first ``n`` documents of each query of ``run_file``."""
    run = table(spark, folder, "run_file").where("query_id is not null and doc_id is not null and score is not null and not isnan(score)")
    best = run.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return search.ranked(best, n).groupBy("query_id").agg(F.array_sort(F.collect_list("doc_id")).alias("top_docs"))


def tf_of(spark: SparkSession, folder: str) -> DataFrame:
    return index.term_frequencies(corpus(spark, folder))


def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    """First row of every document id of the collection."""
    return corpus(spark, folder).select("line_no", "doc_id")


def dedup_last(spark: SparkSession, folder: str) -> DataFrame:
    """Latest row of every id of ``docs_file``."""
    return docs_of(spark, folder)


def dedup_text_first(spark: SparkSession, folder: str) -> DataFrame:
    """First document of every distinct text."""
    return dedup.pick(table(spark, folder, "documents").select("doc_id", "text"), F.col("text"), F.col("doc_id"))


def word_freq(spark: SparkSession, folder: str) -> DataFrame:
    return vocabularies.word_frequencies(corpus(spark, folder))


def vocab(spark: SparkSession, folder: str) -> DataFrame:
    return vocabularies.learn_simple(corpus(spark, folder))


def train_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """The first half of the titles and abstracts, in order."""
    return vocabularies.train_entries(corpus(spark, folder))


def term_doc_tf(spark: SparkSession, folder: str) -> DataFrame:
    return tf_of(spark, folder)


def postings(spark: SparkSession, folder: str) -> DataFrame:
    """Posting lists as text, ``doc:tf`` by document."""
    shown = F.array_join(F.transform("postings", lambda p: F.concat(p["doc_id"], F.lit(":"), p["tf"].cast("string"))), ",")
    return index.postings(tf_of(spark, folder)).select("term", "block", "df", shown.alias("postings"))


def doc_freq(spark: SparkSession, folder: str) -> DataFrame:
    return index.document_frequencies(tf_of(spark, folder))


def idf(spark: SparkSession, folder: str) -> DataFrame:
    built = index.Index.build(corpus(spark, folder))
    return built.idf().select("term", "df", F.round("idf", 6).alias("idf"))


def doc_norm(spark: SparkSession, folder: str) -> DataFrame:
    return index.document_norms(tf_of(spark, folder)).select("doc_id", F.round("norm", 6).alias("norm"))


def query_tf(spark: SparkSession, folder: str) -> DataFrame:
    return search.query_terms(queries_of(spark, folder))


def _index(spark: SparkSession, folder: str) -> index.Index:
    """The index over term frequencies that are counted once and written."""
    return index.Index.by_document(corpus(spark, folder))


def search_all(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 best documents of every query; for small tables, as each query is searched for."""
    built = _index(spark, folder)
    return search.ranked(search.scores(built, queries_of(spark, folder)), TOP).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def tfidf_top100(spark: SparkSession, folder: str) -> DataFrame:
    """The 100 best documents of every test query."""
    top = search.best(_index(spark, folder), tests_of(spark, folder), TOP)
    return top.select("query_id", F.lit(0).alias("iter"), "doc_id", F.round("score", 6).alias("score"))


def tfidf_zero_fill(spark: SparkSession, folder: str) -> DataFrame:
    """The same, lists filled up to 100 with documents that match nothing."""
    built = _index(spark, folder)
    tests = tests_of(spark, folder)
    top = search.with_zero_fill(built, tests, search.best(built, tests, TOP), TOP)
    return top.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def oov_unk(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of each query, and how many of them the vocabulary of the collection lacks."""
    tokens = queries_of(spark, folder).select("query_id", F.explode(T.analyze(F.col("text"))).alias("term"))
    known = vocabularies.unknown_tokens(tokens, vocabularies.learn_simple(corpus(spark, folder)))
    return known.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum((~F.col("known")).cast("long")).alias("n_unknown"))


def bpe_pair_freq(spark: SparkSession, folder: str) -> DataFrame:
    return vocabularies.pair_frequencies(vocabularies.word_frequencies(train_prefix(spark, folder)))


def wordpiece_pair_score(spark: SparkSession, folder: str) -> DataFrame:
    scored = vocabularies.piece_pair_scores(vocabularies.word_frequencies(train_prefix(spark, folder)))
    return scored.select("left", "right", "freq", F.round("score", 6).alias("score"))


def _vocabulary(spark: SparkSession, folder: str, kind: str) -> vocabularies.Vocabulary:
    words = vocabularies.word_frequencies(train_prefix(spark, folder))
    return (vocabularies.learn_bpe if kind == "bpe" else vocabularies.learn_pieces)(words)


def bpe_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens as they are shown: a word's boundary is Ġ."""
    return _vocabulary(spark, folder, "bpe").tables(spark)[0].select("token_id", T.shown(F.col("token")).alias("token"))


def analyze_simple(spark: SparkSession, folder: str) -> DataFrame:
    """Number of tokens of every document of the collection, by the function registered for SQL."""
    registry.register(spark)
    return corpus(spark, folder).select("doc_id", F.expr("size(analyze_simple(text))").alias("n_tokens"))


def wordpiece_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens as they are shown: pieces inside a word begin with ##."""
    tokens = _vocabulary(spark, folder, "wordpiece").tables(spark)[0]
    initial = F.col("token").startswith(" ") & (F.length("token") > 1)
    return tokens.select("token_id", T.continuation(F.col("token"), initial).alias("token"), initial.alias("is_initial"))


def _encoded(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return corpus(spark, folder).select("doc_id", vocabularies.encode(T.analyze(F.col("text")), _vocabulary(spark, folder, kind)).alias("ids"))


def bpe_encode(spark: SparkSession, folder: str) -> DataFrame:
    return _encoded(spark, folder, "bpe")


def wordpiece_encode(spark: SparkSession, folder: str) -> DataFrame:
    return _encoded(spark, folder, "wordpiece")


def bpe_index_df(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequencies of an index over byte-pair tokens instead of words."""
    tf = index.term_frequencies(_encoded(spark, folder, "bpe"), F.transform("ids", lambda x: x.cast("string")))
    return index.document_frequencies(tf)


def qrels_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Relevant pairs (relevance other than 0, also below) of known queries."""
    return passages.relevant(qrels_of(spark, folder), queries_of(spark, folder))


def sentence_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of three sentences of every document."""
    cut = F.posexplode(T.chunks(F.coalesce("text", F.lit("")))).alias("chunk", "passage")
    return docs_of(spark, folder).select("doc_id", cut)


def first_passage(spark: SparkSession, folder: str) -> DataFrame:
    return docs_of(spark, folder).select("doc_id", T.first_sentences(F.coalesce("text", F.lit(""))).alias("passage"))


def _relevant(spark: SparkSession, folder: str) -> DataFrame:
    return passages.relevant(qrels_of(spark, folder), queries_of(spark, folder))


def random_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Five random passages of relevant documents for every query."""
    return passages.random_passages(_relevant(spark, folder), docs_of(spark, folder))


def diverse_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Five diverse passages of relevant documents for every query."""
    return passages.diverse(passages.candidates(_relevant(spark, folder), docs_of(spark, folder)))


def _examples(spark: SparkSession, folder: str, of: str = "not test") -> DataFrame:
    """``(example_id, query, passage, top_docs)``: the first passage of the first relevant document of each query for training."""
    found = passages.candidates(_relevant(spark, folder), docs_of(spark, folder))
    first = found.groupBy("query_id").agg(F.min_by("passage", F.struct("pos", "chunk")).alias("passage"))
    train = queries_of(spark, folder).where(f"({of}) and trim(title) <> ''")
    rows = train.join(first, "query_id").join(top_docs_of(spark, folder), "query_id", "left")
    return rows.select(F.col("query_id").alias("example_id"), F.col("title").alias("query"), "passage", "top_docs")


def _tests(spark: SparkSession, folder: str, tests: DataFrame | None = None) -> DataFrame:
    return (tests or tests_of(spark, folder)).join(top_docs_of(spark, folder), "query_id", "left").select("query_id", F.col("title").alias("query"), "top_docs")


def fewshot_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Examples for each test query and number of shots, without replacement."""
    return fewshot.sample(tests_of(spark, folder), _examples(spark, folder))


def disjoint_examples(spark: SparkSession, folder: str) -> DataFrame:
    """The same among examples that share no word and no top document with the query."""
    return fewshot.disjoint(_tests(spark, folder), _examples(spark, folder))


def fewshot_all(spark: SparkSession, folder: str) -> DataFrame:
    """Examples for every query and number of shots, among the examples of all other queries."""
    return fewshot.sample(queries_of(spark, folder), _examples(spark, folder, "true"))


def disjoint_all(spark: SparkSession, folder: str) -> DataFrame:
    """The same among examples that share no word and no top document with the query."""
    asked = queries_of(spark, folder).where("trim(title) <> ''")
    return fewshot.disjoint(_tests(spark, folder, asked), _examples(spark, folder, "true"))


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    tests, examples = _tests(spark, folder), stored(_examples(spark, folder), "examples")
    return fewshot.prompts(tests, fewshot.disjoint(tests, examples), examples, (0, 1, 2, 3, 4))


def prompt(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of every test query for 0 to 4 shots, line feeds as two characters."""
    return _prompts(spark, folder).select("query_id", "k", "n_shots", T.escape_newlines(F.col("prompt")).alias("prompt"))


def generate(spark: SparkSession, folder: str) -> DataFrame:
    """A passage for every prompt by the stand-in generator, cleaned."""
    return fewshot.generate(_prompts(spark, folder)).select("query_id", "k", T.clean_generated(F.col("passage")).alias("passage"))


def clean_generated(spark: SparkSession, folder: str) -> DataFrame:
    return docs_of(spark, folder).select("doc_id", T.clean_generated(F.col("text")).alias("text"))


def preprocess_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document of the collection without stop words, without lemmas."""
    return corpus(spark, folder).select("doc_id", F.array_join(T.preprocess(F.col("text")), " ").alias("tokens"))


def preprocess_lemmas(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).select("doc_id", F.array_join(T.preprocess(F.col("text"), T.lemma_rule), " ").alias("tokens"))


def expand_query(spark: SparkSession, folder: str) -> DataFrame:
    """Each query five times and the words of its narrative."""
    rows = current_rows(table(spark, folder, "queries_file"), "query_id", "loaded_at", ["title", "narrative"])
    return rows.where("title is not null").select("query_id", T.expand_query(F.col("title"), T.words(F.col("narrative"))).alias("query"))


def run_of(spark: SparkSession, folder: str) -> DataFrame:
    """``(query_id, doc_id)``: the distinct pairs of ``run_file``."""
    return table(spark, folder, "run_file").where("query_id is not null and doc_id is not null").select(id_key("query_id").alias("query_id"), id_key("doc_id").alias("doc_id")).distinct()


def rel_join(spark: SparkSession, folder: str) -> DataFrame:
    """The whole candidate list with the relevance of each pair, 0 where it was not judged."""
    run, judged = run_of(spark, folder), qrels_of(spark, folder)
    pairs = run.unionByName(judged.select("query_id", "doc_id")).distinct()
    return rerank.with_relevance(pairs, judged).select("query_id", "doc_id", "rel")


def _bm25(spark: SparkSession, folder: str, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    terms = queries_of(spark, folder).select("query_id", F.explode(T.words(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    tokens = docs.select("doc_id", T.words(F.lower("text")).alias("tokens"))
    candidates = pairs.join(queries_of(spark, folder).select("query_id"), "query_id", "left_semi")
    return rerank.with_relevance(rerank.bm25(candidates, tokens, terms), qrels_of(spark, folder))


def _bm25_judged(spark: SparkSession, folder: str) -> DataFrame:
    return _bm25(spark, folder, qrels_of(spark, folder), docs_of(spark, folder))


def bm25_run(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 of every candidate of ``run_file`` with a text in the collection; relevance 0 where it was not judged."""
    scored = _bm25(spark, folder, run_of(spark, folder), corpus(spark, folder))
    return scored.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rel")


def bm25_rerank(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 of every judged pair among the judged documents of its query."""
    return _bm25_judged(spark, folder).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rel")


def bm25_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the rank of each document in its query."""
    return rerank.ranked(bm25_rerank(spark, folder)).select("query_id", "doc_id", "rank", "score")


def missing_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of every query of ``run_file``, and how many have no document in the collection."""
    return rerank.unmatched(run_of(spark, folder), corpus(spark, folder))


def ndcg(spark: SparkSession, folder: str) -> DataFrame:
    """NDCG of this ranking for every query and cut-off."""
    per_query = rerank.ndcg(_bm25_judged(spark, folder).withColumn("score", F.round("score", 6)))
    return per_query.select("query_id", "cutoff", F.round("ndcg", 6).alias("ndcg"))


def ndcg_mean(spark: SparkSession, folder: str) -> DataFrame:
    per_query = rerank.ndcg(_bm25_judged(spark, folder).withColumn("score", F.round("score", 6)))
    return rerank.mean_ndcg(per_query).select("cutoff", F.round("ndcg", 6).alias("ndcg"))


def shot_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Mean NDCG of the test queries, expanded by a generated passage, for 0 to 4 shots, all in one plan."""
    made = generate(spark, folder).join(tests_of(spark, folder).select("query_id", "title"), "query_id")
    expanded = made.select("k", "query_id", T.expand_query(F.col("title"), T.preprocess(F.col("passage"))).alias("query"))
    both = F.concat_ws(" ", F.col("k").cast("string"), "query_id")
    terms = expanded.select(both.alias("query_id"), F.explode(T.words(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    judged = qrels_of(spark, folder).join(expanded.select("k", "query_id"), "query_id").withColumn("query_id", both)
    tokens = docs_of(spark, folder).select("doc_id", T.preprocess(F.col("text")).alias("tokens"))
    scored = rerank.with_relevance(rerank.bm25(judged, tokens, terms), judged).withColumn("score", F.round("score", 6))
    per_query = rerank.ndcg(scored).withColumn("k", F.split("query_id", " ")[0].cast("int"))
    return rerank.mean_ndcg(per_query, ["k"]).select("k", "cutoff", F.round("ndcg", 6).alias("ndcg"))


QUERIES = {
    f.__name__: f
    for f in (
        dedup_first, dedup_last, dedup_text_first, word_freq, vocab, train_prefix, term_doc_tf, postings, doc_freq, idf, doc_norm, query_tf, tfidf_top100,
        tfidf_zero_fill, oov_unk, bpe_pair_freq, wordpiece_pair_score, bpe_vocab, wordpiece_vocab, bpe_encode, wordpiece_encode, bpe_index_df, qrels_filtered,
        sentence_chunks, first_passage, random_passages, diverse_passages, fewshot_sample, disjoint_examples, prompt, generate, clean_generated,
        preprocess_tokens, preprocess_lemmas, expand_query, rel_join, bm25_run, bm25_rerank, ndcg, ndcg_mean, shot_sweep,
        analyze_simple, fewshot_all, disjoint_all, bm25_ranked, missing_candidates,
    )
}

_TRIM = r"lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
_KEY = _TRIM.format
_CUT = """list_filter(regexp_split_to_array(lower(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g')), '[ ,.:;"'']'), lambda x: x <> '')"""
_CORPUS = f"""
corpus as (
  select {_KEY('doc_id')} as doc_id, line_no, title, abstract, coalesce(title, '') || ' ' || coalesce(abstract, '') as text
  from cord19_trec_covid_docs where doc_id is not null qualify row_number() over (partition by {_KEY('doc_id')} order by line_no) = 1
),
tf as (select term, doc_id, count(*) as tf from (select doc_id, unnest({_CUT.format('text')}) as term from corpus) group by 1, 2),
df as (select term, count(*) as df from tf group by 1),
norms as (select doc_id, sqrt(sum(power(1 + log2(tf), 2))) as norm from tf group by 1)"""
_QUERIES = f"""
queries as (
  select query_id, coalesce(title, '') as title, concat_ws(' ', title, description, narrative) as text, narrative, coalesce(try_cast(query_id as bigint) % 100 = 0, false) as test
  from queries_file where query_id is not null qualify row_number() over (partition by query_id order by loaded_at desc nulls last) = 1
),
tests as (select * from queries where test)"""
_DOCS = f"""
docs as (select {_KEY('doc_id')} as doc_id, text from docs_file where doc_id is not null qualify row_number() over (partition by doc_id order by loaded_at desc nulls last) = 1),
qrels as (
  select {_KEY('query_id')} as query_id, {_KEY('doc_id')} as doc_id, rel, line_no as pos from qrels_file
  where rel is not null and {_KEY('query_id')} <> '' and {_KEY('doc_id')} <> ''
  qualify row_number() over (partition by {_KEY('query_id')}, {_KEY('doc_id')} order by line_no desc) = 1
),
rel as (select query_id, doc_id, pos from qrels where rel <> 0 and query_id in (select query_id from queries))"""
_SCORES = """
qtf as (select query_id, term, count(*) as qtf from (select query_id, unnest({cut}) as term from tests) group by 1, 2),
scores as (
  select query_id, doc_id, sum((1 + log2(qtf)) * log2(1 + n / cast(df as double)) * (1 + log2(tf))) / any_value(norm) as score
  from qtf join df using (term) join tf using (term) join norms using (doc_id), (select cast(count(*) as double) as n from norms) group by 1, 2
)"""
_TRAIN = """
entries as (
  select (row_number() over (order by line_no) - 1) * 2 as row, coalesce(title, '') as title, coalesce(abstract, '') as abstract, count(*) over () as total from corpus
),
train as (
  select pos, text from (select row as pos, title as text, total from entries union all select row + 1, abstract, total from entries) where pos < total
),
words as (select term, count(*) as freq from (select unnest({cut}) as term from train) group by 1)"""
_CHUNKS = """
cut as (
  select doc_id, chunk, passage from (
    select doc_id, row_number() over (partition by doc_id order by i) - 1 as chunk, passage from (
      select doc_id, i, array_to_string(s[i * 3 + 1 : i * 3 + 3], '. ') as passage
      from (select doc_id, string_split(coalesce(text, ''), '. ') as s from docs), lateral (select unnest(range(0, cast(ceil(len(s) / 3.0) as bigint))) as i)
    ) where passage <> ''
  )
)"""
_EXAMPLES = f"""
top as (
  select query_id, list(doc_id) as top_docs from (
    select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id desc) as r
    from (select query_id, doc_id, max(score) as score from run_file where query_id is not null and doc_id is not null and score is not null and not isnan(score) group by 1, 2)
  ) where r <= {TOP_DOCS} group by 1
),
firsts as (select query_id, passage from rel join cut using (doc_id) qualify row_number() over (partition by query_id order by pos, chunk) = 1),
examples as (
  select q.query_id as example_id, q.title as query, passage, coalesce(top_docs, []) as top_docs, row_number() over (order by md5('0|' || q.query_id), q.query_id) - 1 as at
  from queries q join firsts using (query_id) left join top using (query_id) where not q.test and trim(q.title) <> ''
),
n as (select count(*) as n from examples),
wanted as (
  select query_id, title, k, ('0x' || substr(md5('0|start|' || query_id || '|' || k), 1, 12))::bigint % n as start, n
  from tests, (select unnest([1, 2, 3, 4]) as k), n
)"""
_EXAMPLES_ALL = _EXAMPLES.replace("where not q.test and trim", "where trim").replace("from tests, (select unnest([1", "from queries, (select unnest([1")
_DISJOINT = _EXAMPLES + """,
split_words as (select w.*, list_filter(regexp_split_to_array(w.title, '[\\s\\x0B\\x{85}\\p{Z}]+'), lambda x: x <> '') as ws, coalesce(top_docs, []) as td from wanted w left join top using (query_id)),
fits as (
  select s.query_id, s.k, e.example_id, row_number() over (partition by s.query_id, s.k order by (e.at - s.start + s.n) % s.n) - 1 as shot, e.query, e.passage
  from split_words s, examples e
  where not list_has_any(s.ws, list_filter(regexp_split_to_array(e.query, '[\\s\\x0B\\x{85}\\p{Z}]+'), lambda x: x <> '')) and not list_has_any(s.td, e.top_docs)
),
chosen as (select * from fits where shot < k)"""
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)
def _tokens_sql(column: str, each: str = "") -> str:
    """Tokens of a text as the functions make them, joined by blanks; ``each`` is applied to every one, called x."""
    clitic = T.CLITIC.replace("'", "''")
    cut = (
        f"regexp_extract_all(regexp_replace(trim(regexp_replace(lower({column}), '[\\s\\x0B\\x{{85}}\\p{{Z}}]+', ' ', 'g')), "
        f"'({clitic})([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)', ' \\1 \\2', 'g'), '{clitic}"
        "|[\\p{L}\\p{M}\\p{N}_]+(?:[-.][\\p{L}\\p{M}\\p{N}_]+)*|[^\\s\\x0B\\x{85}\\p{Z}\\p{L}\\p{M}\\p{N}_]')"
    )
    kept = f"list_filter({cut}, lambda x: x not in ({_STOP}))"
    if each:
        kept = f"list_transform({kept}, lambda x: {each})"
    return f"array_to_string(list_filter({kept}, lambda x: regexp_full_match(x, '\\p{{L}}+')), ' ')"


_BM25 = """
d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\s\\x0B\\x{85}\\p{Z}]+'), lambda x: x <> '') as tokens from docs),
pairs as (select query_id, doc_id, len(tokens) as dl, rel from qrels join d using (doc_id) where query_id in (select query_id from queries)),
st as (select query_id, cast(count(*) as double) as n, avg(dl) as avgdl from pairs group by 1),
dtf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(tokens) as term from d) group by 1, 2),
held as (select query_id, doc_id, dl, term, tf from pairs join dtf using (doc_id)),
qdf as (select query_id, term, cast(count(*) as double) as df from held group by 1, 2),
i as (select query_id, term, ln(n - df + 0.5e0) - ln(df + 0.5e0) as idf from qdf join st using (query_id)),
fl as (select query_id, avg(idf) * 0.25e0 as fl from i group by 1),
qt as (select query_id, term, count(*) as qtf from (select query_id, unnest(list_filter(regexp_split_to_array(text, '[\\s\\x0B\\x{85}\\p{Z}]+'), lambda x: x <> '')) as term from queries) group by 1, 2),
sc as (
  select query_id, doc_id, sum(qtf * case when idf < 0 then fl else idf end * tf * 5.46e0 / (tf + 4.46e0 * (0.18e0 + 0.82e0 * dl / avgdl))) as score
  from held join i using (query_id, term) join fl using (query_id) join qt using (query_id, term) join st using (query_id) group by 1, 2
),
bm as (select query_id, doc_id, round(coalesce(score, 0), 6) as score, rel from pairs left join sc using (query_id, doc_id))"""
_NDCG = _BM25 + """,
r as (
  select query_id, rel, count(*) over t as c, avg(rel) over t as g, row_number() over (partition by query_id order by score desc, doc_id) as a,
    row_number() over (partition by query_id order by rel desc, doc_id) as z from bm window t as (partition by query_id, score)
),
nd as (
  select query_id, cutoff, sum(case when a <= cutoff then g / log2(a + 1) else 0 end) as dcg, sum(case when z <= cutoff then rel / log2(z + 1) else 0 end) as ideal
  from r, (select unnest([5, 10, 50]) as cutoff) group by 1, 2
),
per_query as (select query_id, cutoff, case when ideal <> 0 then dcg / ideal else 0 end as ndcg from nd)"""

_SPLIT = "list_filter(regexp_split_to_array({0}, '[\\s\\x0B\\x{{85}}\\p{{Z}}]+'), lambda x: x <> '')"
_LEMMA = """case when length(x) <= 3 then x when regexp_matches(x, 'ies$') then regexp_replace(x, 'ies$', 'y') when regexp_matches(x, '(s|x|z|ch|sh)es$') then regexp_replace(x, '(s|x|z|ch|sh)es$', '\\1')
  when regexp_matches(x, 'men$') then regexp_replace(x, 'men$', 'man') when regexp_matches(x, 'ves$') then regexp_replace(x, 'ves$', 'f')
  when regexp_matches(x, '[^s]s$') and not regexp_matches(x, '(us|is)$') then regexp_replace(x, 's$', '') else x end"""
_MADE = """,
asked as (
  select t.query_id, k.k, coalesce(string_agg('Example Query: ' || c.query || chr(10) || 'Example Passage: ' || c.passage || chr(10) || chr(10), '' order by c.shot), '') || 'Query: ' || t.title || chr(10) || 'Passage: ' as p
  from tests t cross join (select unnest([0, 1, 2, 3, 4]) as k) k left join chosen c on c.query_id = t.query_id and c.k = k.k group by t.query_id, k.k, t.title
),
ended as (
  select query_id, k, list_filter(string_split(p, chr(10)), lambda x: starts_with(x, 'Example Passage: ')) as e, list_filter(string_split(p, chr(10)), lambda x: starts_with(x, 'Query: ')) as q from asked
),
made as (
  select query_id, k, regexp_replace(regexp_replace(regexp_replace(case when len(e) > 0 then substr(e[len(e)], 18) else substr(q[len(q)], 8) end, '\\n+', ' ', 'g'), '\\t+', ' ', 'g'), ' +', ' ', 'g') as passage
  from ended
)"""
_DIVERSE = """,
cand as (select query_id, pos, chunk, passage, row_number() over (partition by query_id order by pos, chunk) - 1 as i, count(*) over (partition by query_id) as n from rel join cut using (doc_id)),
tok as (select query_id, i, n, unnest(regexp_extract_all(lower(passage), '[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}]{2,}')) as term from cand where n > 5),
ptf as (select query_id, i, n, term, count(*) as tf from tok group by all),
raw as (select *, tf * (ln((1e0 + n) / (1e0 + count(*) over (partition by query_id, term))) + 1e0) as rw from ptf),
unit as (select query_id, i, term, rw / sqrt(sum(rw * rw) over (partition by query_id, i)) as w from raw),
p0 as (select query_id, i from cand where n > 5 and i = 0),
c0 as (select query_id, i, 0e0 as sim from cand where n > 5 and query_id in (select query_id from unit))""" + "".join(
    f""",
d{s} as (select u.query_id, u.i, sum(u.w * v.w) as dot from p{s - 1} p join unit v on v.query_id = p.query_id and v.i = p.i join unit u on u.query_id = v.query_id and u.term = v.term group by all),
c{s} as (select c.query_id, c.i, c.sim + coalesce(dot, 0) as sim from c{s - 1} c join p{s - 1} p on p.query_id = c.query_id and p.i <> c.i left join d{s} d on d.query_id = c.query_id and d.i = c.i),
p{s} as (select query_id, i from (select query_id, i, round(sim / {s}, 12) as m from c{s}) where m < 1 - 1e-12 qualify row_number() over (partition by query_id order by m, i) = 1)"""
    for s in range(1, 5)
)

_W = "with " + _CORPUS
_WQ = "with " + _QUERIES
_WD = "with " + _QUERIES + "," + _DOCS
_PIECES = ",\nsym as (select term, freq, list_transform(string_split(term, ''), lambda c, i: case when i = 1 then ' ' || c else c end) as s from words where length(term) > 1)"

ORACLE = {
    "dedup_first": _W + " select line_no, doc_id from corpus",
    "dedup_last": _WD + " select doc_id, text from docs",
    "dedup_text_first": "select min(doc_id) as doc_id, text from documents where text is not null group by text",
    "word_freq": _W + " select term, cast(sum(tf) as bigint) as freq from tf group by 1",
    "vocab": _W + " select term from df union all select 'UNK'",
    "train_prefix": _W + "," + _TRAIN.format(cut=_CUT.format("text")) + " select pos, text from train",
    "term_doc_tf": _W + " select * from tf",
    "postings": _W + """, placed as (select *, (row_number() over (partition by term order by doc_id) - 1) // 100000 as block, count(*) over (partition by term) as df from tf)
    select term, cast(block as bigint) as block, df, string_agg(doc_id || ':' || tf, ',' order by doc_id) as postings from placed group by 1, 2, 3""",
    "doc_freq": _W + " select * from df",
    "idf": _W + " select term, df, round(log2(1 + n / cast(df as double)), 6) as idf from df, (select cast(count(*) as double) as n from norms)",
    "doc_norm": _W + " select doc_id, round(norm, 6) as norm from norms",
    "query_tf": _WQ + f" select query_id, term, count(*) as qtf from (select query_id, unnest({_CUT.format('text')}) as term from queries) group by 1, 2",
    "tfidf_top100": _W + "," + _QUERIES + "," + _SCORES.format(cut=_CUT.format("text"))
    + f" select query_id, 0 as iter, doc_id, round(score, 6) as score from scores qualify row_number() over (partition by query_id order by score desc, doc_id desc) <= {TOP}",
    "tfidf_zero_fill": _W + "," + _QUERIES + "," + _SCORES.format(cut=_CUT.format("text"))
    + f""" select t.query_id, d.doc_id, round(coalesce(score, 0), 6) as score from tests t cross join norms d left join scores s on s.query_id = t.query_id and s.doc_id = d.doc_id
    qualify row_number() over (partition by t.query_id order by coalesce(score, 0) desc, d.doc_id desc) <= {TOP}""",
    "oov_unk": _W + "," + _QUERIES + f""" select query_id, count(*) as n_terms, count(*) filter (where d.term is null) as n_unknown
    from (select query_id, unnest({_CUT.format('text')}) as term from queries) q left join df d on d.term = q.term group by 1""",
    "bpe_pair_freq": _W + "," + _TRAIN.format(cut=_CUT.format("text")) + """ select left_ as "left", right_ as "right", cast(sum(freq) as bigint) as freq from (
    select w[i] as left_, w[i + 1] as right_, freq from (select ' ' || term as w, freq from words), lateral (select unnest(range(1, length(w))) as i)) group by 1, 2""",
    "wordpiece_pair_score": _W + "," + _TRAIN.format(cut=_CUT.format("text")) + _PIECES + """,
    one as (select t, sum(freq) as f from (select unnest(s) as t, freq from sym) group by 1),
    two as (select l, r, sum(freq) as freq from (select s[i] as l, s[i + 1] as r, freq from sym, lateral (select unnest(range(1, len(s))) as i)) group by 1, 2),
    g as (select t, case when regexp_full_match(t, ' ?[A-Za-z0-9]+') then sqrt(cast(f as double)) else cast(f as double) end as g from one)
    select l as "left", r as "right", cast(freq as bigint) as freq, round(cast(freq as double) / a.g / b.g, 6) as score from two join g a on a.t = l join g b on b.t = r""",
    "qrels_filtered": _WD + " select query_id, doc_id, pos from rel",
    "sentence_chunks": _WD + "," + _CHUNKS + " select doc_id, chunk, passage from cut",
    "first_passage": _WD + " select doc_id, array_to_string(string_split(coalesce(text, ''), '. ')[1:3], '. ') as passage from docs",
    "random_passages": _WD + """, drawn as (
      select query_id, draw, doc_id from rel, (select unnest(range(0, 5)) as draw)
      qualify row_number() over (partition by query_id, draw order by md5('0|' || query_id || '|' || draw || '|' || doc_id), doc_id) = 1
    ),
    placed as (select *, string_split(coalesce(text, ''), '. ') as s, ('0x' || substr(md5('0|start|' || query_id || '|' || draw), 1, 8))::bigint as h from drawn join docs using (doc_id))
    select query_id, cast(draw as int) as draw, doc_id, passage from (select query_id, draw, doc_id, array_to_string(s[h % len(s) + 1 : h % len(s) + 4], '. ') as passage from placed) where passage <> ''""",
    "fewshot_sample": _WD + "," + _CHUNKS + "," + _EXAMPLES + """ select query_id, k, cast(shot as int) as shot, example_id
    from (select query_id, k, start, n, unnest(range(0, least(k, n))) as shot from wanted) w join examples e on e.at = (w.start + w.shot) % w.n""",
    "disjoint_examples": _WD + "," + _CHUNKS + "," + _DISJOINT + " select query_id, k, cast(shot as int) as shot, example_id from chosen",
    "prompt": _WD + "," + _CHUNKS + "," + _DISJOINT + """ select t.query_id, k.k, cast(count(c.example_id) as int) as n_shots,
    replace(coalesce(string_agg('Example Query: ' || c.query || chr(10) || 'Example Passage: ' || c.passage || chr(10) || chr(10), '' order by c.shot), '') || 'Query: ' || t.title || chr(10) || 'Passage: ', chr(10), '\\n') as prompt
    from tests t cross join (select unnest([0, 1, 2, 3, 4]) as k) k left join chosen c on c.query_id = t.query_id and c.k = k.k group by t.query_id, k.k, t.title""",
    "clean_generated": _WD + " select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\n+', ' ', 'g'), '\\t+', ' ', 'g'), ' +', ' ', 'g') as text from docs",
    "analyze_simple": _W + f" select doc_id, cast(len({_CUT.format('text')}) as int) as n_tokens from corpus",
    "fewshot_all": _WD + "," + _CHUNKS + "," + _EXAMPLES_ALL + """, met as (
      select query_id, k, shot, example_id, min(case when example_id = query_id then shot end) over (partition by query_id, k) as own
      from (select query_id, k, start, n, unnest(range(0, least(k + 1, n))) as shot from wanted) w join examples e on e.at = (w.start + w.shot) % w.n
    ),
    rest as (select query_id, k, case when shot > own then shot - 1 else shot end as shot, example_id from met where own is null or shot <> own)
    select query_id, k, cast(shot as int) as shot, example_id from rest where shot < k""",
    "disjoint_all": _WD + "," + _CHUNKS + "," + _DISJOINT.replace(_EXAMPLES, _EXAMPLES_ALL)
    + " select query_id, k, cast(shot as int) as shot, example_id from chosen where query_id in (select query_id from queries where trim(title) <> '')",
    "bm25_run": _WD + "," + _CORPUS + f""",
    run as (select distinct {_KEY('query_id')} as query_id, {_KEY('doc_id')} as doc_id from run_file where query_id is not null and doc_id is not null),
    d as (select doc_id, {_SPLIT.format('lower(text)')} as tokens from corpus),
    pairs as (
      select r.query_id, r.doc_id, len(tokens) as dl, coalesce(rel, 0) as rel from run r join d using (doc_id) left join qrels j on j.query_id = r.query_id and j.doc_id = r.doc_id
      where r.query_id in (select query_id from queries)
    ),"""
    + _BM25[_BM25.index("st as ("):] + " select query_id, doc_id, score, rel from bm",
    "bm25_ranked": _WD + "," + _BM25 + " select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, score from bm",
    "missing_candidates": _W + f""", run as (select distinct {_KEY('query_id')} as query_id, {_KEY('doc_id')} as doc_id from run_file where query_id is not null and doc_id is not null)
    select query_id, count(*) as n_candidates, count(*) filter (where c.doc_id is null) as n_missing from run r left join (select doc_id from corpus) c on c.doc_id = r.doc_id group by 1""",
    "generate": _WD + "," + _CHUNKS + "," + _DISJOINT + _MADE + " select query_id, k, passage from made",
    "diverse_passages": _WD + "," + _CHUNKS + _DIVERSE + """, picks as (
      select query_id, cast(i as int) as step, i from cand where n <= 5 union all select query_id, 0, i from p0 union all select query_id, 1, i from p1
      union all select query_id, 2, i from p2 union all select query_id, 3, i from p3 union all select query_id, 4, i from p4
    )
    select query_id, step, pos, cast(chunk as int) as chunk, passage from picks join cand using (query_id, i)""",
    "preprocess_lemmas": _W + f" select doc_id, {_tokens_sql('text', _LEMMA)} as tokens from corpus",
    "shot_sweep": _WD + "," + _CHUNKS + "," + _DISJOINT + _MADE + f""",
    expanded as (select m.k || ' ' || query_id as query_id, query_id as raw_id, repeat(title || ' ', 5) || {_tokens_sql('passage')} as query from made m join tests using (query_id)),
    qt as (select query_id, term, count(*) as qtf from (select query_id, unnest({_SPLIT.format('query')}) as term from expanded) group by 1, 2),
    d as (select doc_id, list_filter(string_split({_tokens_sql("coalesce(text, '')")}, ' '), lambda x: x <> '') as tokens from docs),
    pairs as (select e.query_id, doc_id, len(tokens) as dl, rel from qrels q join expanded e on e.raw_id = q.query_id join d using (doc_id)),"""
    + _BM25[_BM25.index("st as ("):_BM25.index("qt as (")] + _BM25[_BM25.index("sc as ("):] + _NDCG[len(_BM25):]
    + " select cast(split_part(query_id, ' ', 1) as int) as k, cutoff, round(avg(ndcg), 6) as ndcg from per_query group by 1, 2",
    "preprocess_tokens": _W + f" select doc_id, {_tokens_sql('text')} as tokens from corpus",
    "expand_query": _WQ + """ select query_id, repeat(title || ' ', 5) || array_to_string(list_filter(regexp_split_to_array(coalesce(narrative, ''), '[\\s\\x0B\\x{85}\\p{Z}]+'), lambda x: x <> ''), ' ') as query
    from queries where query_id in (select query_id from (select * from queries_file qualify row_number() over (partition by query_id order by loaded_at desc nulls last) = 1) where title is not null)""",
    "rel_join": _WD + f""", pairs as (select {_KEY('query_id')} as query_id, {_KEY('doc_id')} as doc_id from run_file where query_id is not null and doc_id is not null union select query_id, doc_id from qrels)
    select query_id, doc_id, coalesce(rel, 0) as rel from pairs left join qrels using (query_id, doc_id)""",
    "bm25_rerank": _WD + "," + _BM25 + " select query_id, doc_id, score, rel from bm",
    "ndcg": _WD + "," + _NDCG + " select query_id, cutoff, round(ndcg, 6) as ndcg from per_query",
    "ndcg_mean": _WD + "," + _NDCG + " select cutoff, round(avg(ndcg), 6) as ndcg from per_query group by 1",
}
