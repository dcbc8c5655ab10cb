"""Queries of the problems on text (1, 2, 3, 6, 8, 9, 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.llm import bpe, mixing, pieces, pii, sentences, terms, topn
from siltwork.session import scratch_path
from siltwork.sources.tables import current_rows, table


def _current(spark: SparkSession, folder: str) -> DataFrame:
    return current_rows(table(spark, folder, "docs_file"), "doc_id", "loaded_at", ["text"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence units of the current rows of ``docs_file``."""
    return sentences.sentence_units(_current(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten documents of every query of ``run_file``."""
    return topn.top_items(table(spark, folder, "run_file"), "query_id", "doc_id", "score", 10).select("query_id", "doc_id")


def p2_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The same with score and rank."""
    return topn.top_items(table(spark, folder, "run_file"), "query_id", "doc_id", "score", 10)


def _term_state(spark: SparkSession, folder: str) -> terms.TermState:
    """Two loads: all rows as last delivered, then the records as they are, by their difference to the stored state.

    The second load changes the text of ids whose first row differs, so additions and subtractions meet in one merge.
    """
    docs, path = table(spark, folder, "cord19_trec_covid_docs"), scratch_path(spark, "terms")
    terms.TermState(spark, path).apply(terms.first_records(docs.withColumn("line_no", -F.col("line_no"))))
    return terms.TermState(spark, path).apply(terms.first_records(docs))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms that are too rare or too common."""
    return terms.marked(_term_state(spark, folder)).where("mark is not null").select("term", "mark")


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every term with occurrences, records and mark."""
    return terms.marked(_term_state(spark, folder))


def p3_delta(spark: SparkSession, folder: str) -> DataFrame:
    """The same counts; all three come out of the merge of a second load into the first."""
    return p3_counts(spark, folder)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Current rows of ``docs_file`` with a text above the limit, and whether a stretch of it cannot be cut naturally."""
    return pieces.oversized(pieces.boundary_tables(pieces.ranges(_current(spark, folder)), limit=pieces.LIMIT))


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of those texts."""
    return pieces.pieces(pieces.ranges(_current(spark, folder)))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return table(spark, folder, "documents").select("doc_id", bpe.ids_of(F.col("text")).alias("ids"))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = mixing.sized(table(spark, folder, "documents"))
    return sizes, mixing.plan(sizes, table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that cannot reach their share."""
    return mixing.unreachable(*_mix(spark, folder))


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares of every source."""
    return mixing.report(*_mix(spark, folder))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix with their number of copies."""
    return mixing.mixed(*_mix(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Places with personal data in ``documents``."""
    return pii.places(table(spark, folder, "documents"), table(spark, folder, "name_list"))


def p10_text(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with these places replaced by placeholders."""
    return pii.replaced(table(spark, folder, "documents"), p10_found(spark, folder))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_ranked, p3_found, p3_counts, p3_delta, p6_found, p6_pieces, p8_ids, p9_found, p9_report, p9_mix, p10_found, p10_text)}

_TOP = """
with best as (
  select query_id, doc_id, max(case when score = 0 then 0.0 else score end) as score from run_file
  where query_id is not null and doc_id is not null and score is not null and not isnan(score) group by 1, 2
),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id desc) as int) as rank from best)
"""

_TERMS = r"""
with keyed as (
  select lower(regexp_replace(doc_id, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as key, line_no, text from cord19_trec_covid_docs where doc_id is not null
),
records as (select key, text from keyed qualify row_number() over (partition by key order by line_no) = 1),
t as (
  select key, unnest(regexp_split_to_array(lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g')), '[ \t\n\x0b\f\r,.:;"'']+')) as term from records
),
counts as (select term, count(*) as n_occurrences, count(distinct key) as n_records from t where term <> '' group by 1),
marked as (
  select *, case when n_records < 3 then 'rare' when n_records * 100 > 30 * (select count(*) from records) then 'common' end as mark from counts
)
"""

ORACLE = {
    "p2_found": _TOP + "select query_id, doc_id from ranked where rank <= 10",
    "p2_ranked": _TOP + "select * from ranked where rank <= 10",
    "p3_found": _TERMS + "select term, mark from marked where mark is not null",
    "p3_counts": _TERMS + "select * from marked",
    "p3_delta": _TERMS + "select * from marked",
}
