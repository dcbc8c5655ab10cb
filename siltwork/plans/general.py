"""Queries of the general problems (4, 5, 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltwork.operators import parsing, references, skew
from siltwork.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references of ``qrels_file``, one row each."""
    loads = {f: table(spark, folder, t) for f, t in references.FIELDS.items()}
    return references.orphans(table(spark, folder, "qrels_file"), loads, table(spark, folder, "removed_keys"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references counted per table, month and reason."""
    return references.orphan_report(p4_found(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of ``docs_raw`` that do not load, with the reason."""
    return parsing.rejected(table(spark, folder, "docs_raw"))


def p5_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of ``docs_raw`` that load, as rows of ``docs_file``."""
    return parsing.loaded(table(spark, folder, "docs_raw"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that hold at least 2 % of the distinct pairs."""
    return skew.heavy_keys(skew.pairs_of(table(spark, folder, "postings_list"))).select("key_field", "key_value")


def p7_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, distinct partners and total tf of every term and document."""
    return skew.totals(skew.pairs_of(table(spark, folder, "postings_list")))


def p7_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact median and 90 % quantile of tf of every term."""
    rows = table(spark, folder, "postings_list").where("term_id is not null and doc_id is not null")
    return skew.key_quantiles(rows, ["term_id"], "tf", [0.5, 0.9]).withColumn("quantile", F.col("quantile").cast("double"))


QUERIES = {f.__name__: f for f in (p4_found, p4_report, p5_found, p5_loaded, p7_found, p7_totals, p7_quantiles)}

_ID = r"lower(regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"

_P4 = f"""
with refs as (
  select line_no, f as ref_field, {_ID.format('raw')} as key, judged_at, strftime(judged_at, '%Y-%m') as ref_period
  from (select line_no, judged_at, unnest(['doc_id', 'query_id']) as f, unnest([doc_id, query_id]) as raw from qrels_file)
  where judged_at is not null and {_ID.format('raw')} <> ''
),
loads as (
  select 'doc_id' as ref_field, {_ID.format('doc_id')} as key, loaded_at from docs_file
  union all select 'query_id', {_ID.format('query_id')}, loaded_at from queries_file
),
gone as (
  select case table_name when 'docs_file' then 'doc_id' when 'queries_file' then 'query_id' end as ref_field, {_ID.format('key_value')} as key, removed_at
  from removed_keys
),
l as (
  select r.line_no, r.ref_field, count(x.loaded_at) as n_loads, max(case when x.loaded_at <= r.judged_at then x.loaded_at end) as l
  from refs r left join loads x on x.ref_field = r.ref_field and x.key = r.key group by 1, 2
),
g as (
  select r.line_no, r.ref_field, max(case when x.removed_at <= r.judged_at then x.removed_at end) as g
  from refs r left join gone x on x.ref_field = r.ref_field and x.key = r.key group by 1, 2
),
orphans as (
  select line_no, ref_field, case when n_loads = 0 then 'missing' when l is null then 'late' else 'removed' end as reason, ref_period
  from refs join l using (line_no, ref_field) join g using (line_no, ref_field)
  where l is null or g >= l
)
"""

_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'
_P5 = rf"""
with lines as (select line_no, regexp_replace(coalesce(line, ''), '\r$', '') as body from docs_raw),
ok as (
  select line_no, body, regexp_full_match(body, '(?s){_FIELD}(?:\t{_FIELD})*') as quoted_well,
         list_transform(regexp_extract_all(chr(9) || body, '(?s)\t({_FIELD})', 1),
           lambda x: case when starts_with(x, '"') then replace(x[2:length(x) - 1], '""', '"') else x end) as f
  from lines
),
parts as (
  select *, regexp_replace(regexp_replace(f[1], '^\x{{FEFF}}', ''), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') as doc_id from ok
),
judged as (
  select *, case when not quoted_well then 'quoting' when len(f) <> 4 then 'columns'
      when not regexp_full_match(doc_id, '[Dd][0-9]{{9}}') then 'doc_id'
      when not regexp_matches(f[4], '[^\s\p{{Z}}]') or regexp_matches(f[4], '[\x00-\x08\x0b-\x1f\x7f\x{{FFFD}}]') then 'text' end as reason
  from parts
)
"""

_PAIRS = f"""
with pairs as (
  select term_id, {_ID.format('doc_id')} as doc_key, count(*) as n_rows, sum(tf) as tf from postings_list
  where term_id is not null and doc_id is not null group by 1, 2
),
keyed as (
  select 'term_id' as key_field, cast(term_id as varchar) as key_value, n_rows, tf from pairs
  union all select 'doc_id', doc_key, n_rows, tf from pairs
),
totals as (select key_field, key_value, sum(n_rows) as n_rows, count(*) as n_partners, sum(tf) as total_tf from keyed group by 1, 2)
"""

ORACLE = {
    "p4_found": _P4 + "select * from orphans",
    "p4_report": _P4
    + "select case ref_field when 'doc_id' then 'docs_file' else 'queries_file' end as table_name, ref_period, reason, count(*) as n_refs from orphans group by 1, 2, 3",
    "p5_found": _P5 + "select line_no, reason from judged where reason is not null",
    "p5_loaded": _P5 + "select line_no, doc_id, f[2] as url, f[3] as title, f[4] as text from judged where reason is null",
    "p7_found": _PAIRS + "select key_field, key_value from totals where n_partners * 100 >= 2 * (select count(*) from pairs)",
    "p7_totals": _PAIRS + "select key_field, key_value, cast(n_rows as bigint) as n_rows, n_partners, cast(total_tf as bigint) as total_tf from totals",
    "p7_quantiles": """
with r as (
  select term_id, tf, row_number() over (partition by term_id order by tf) as rn, count(*) over (partition by term_id) as n
  from postings_list where term_id is not null and doc_id is not null and tf is not null
)
select term_id, q as quantile, n, tf as value from r, (select unnest([cast(0.5 as double), cast(0.9 as double)]) as q)
where rn = greatest(1, cast(ceil(q * n) as bigint))""",
}
