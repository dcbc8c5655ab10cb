"""Rows that fail to parse (problem 5).

Lines are read permissively under an explicit schema whose last field keeps the raw text of what the reader could not
place. That raw text is classified again by checks in the stated order: quoting, column count, casts. The reader is not
exact about quotes and line breaks inside a line and about blank lines, so the raw text of such lines goes the same way, whatever it made of
them; and a line of more fields than it takes is not shown to it at all.

Edge cases: a null or empty line has one empty field and fails by its columns; one carriage return at the end is not
part of the line; very long lines and many quotes are matched without recursion (possessive patterns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schema of the delivery; the last field keeps the raw text of what the reader could not place.
SCHEMA = "doc_id string, url string, title string, text string, _corrupt string"
N_FIELDS = 4
#: Most fields that the reader takes.
MAX_FIELDS = 4096
#: A field, a whole line, and the forms of id and text that load.
FIELD = r'(?:"(?:[^"]++|"")*+"(?=\t|\z)|(?!")[^\t]*+)'
LINE = rf"\A{FIELD}(?:\t{FIELD})*+\z"
DOC_ID = r"\A[Dd][0-9]{9}\z"
BAD_TEXT = "[\\x00-\\x08\\x0b-\\x1f\\x7f\\ufffd]"


def parsed(raw: DataFrame) -> DataFrame:
    """``(line_no, line, fields array<string>, reason)``; ``reason`` is null for lines that load.

    ``fields`` has the values without their quotes, or is null where the quoting is broken.
    """
    line = F.regexp_replace(F.coalesce("line", F.lit("")), r"\r\z", "")
    options = {"sep": "\t", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "maxColumns": str(MAX_FIELDS), "emptyValue": ""}
    df = raw.select("line_no", "line", line.alias("body"))
    n_tabs = F.length("body") - F.length(F.translate("body", "\t", ""))
    df = df.withColumn("row", F.when(n_tabs < MAX_FIELDS, F.from_csv("body", SCHEMA, options)))
    # raw text that is classified again: what the reader has marked, what it is not exact about, what it was not shown
    unsure = F.col("row").isNull() | F.col("body").rlike(r'["\n\r]|(?U)\A\s*\z')
    df = df.withColumn("corrupt", F.coalesce(F.col("row._corrupt"), F.when(unsure, F.col("body"))))
    placed = F.array(*[F.coalesce(F.col(f"row.{c}"), F.lit("")) for c in ("doc_id", "url", "title", "text")])
    pieces = F.regexp_extract_all(F.concat(F.lit("\t"), "corrupt"), F.lit(rf"\t({FIELD})"), F.lit(1))
    unquoted = F.transform(pieces, lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    again = F.when(F.col("corrupt").rlike(LINE), unquoted)
    df = df.withColumn("fields", F.when(F.col("corrupt").isNull(), placed).otherwise(again))
    return df.select("line_no", "line", "fields", _reason(F.col("fields")).alias("reason"))


def _value(fields: Column, i: int) -> Column:
    return F.get(fields, F.lit(i))


def doc_id_of(fields: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_value(fields, 0), r"\A\x{FEFF}", ""), r"(?U)\A\s+|\s+\z", "")


def _reason(fields: Column) -> Column:
    text = _value(fields, 3)
    return (
        F.when(fields.isNull(), "quoting")
        .when(F.size(fields) != N_FIELDS, "columns")
        .when(~doc_id_of(fields).rlike(DOC_ID), "doc_id")
        .when(~text.rlike(r"(?U)\S") | text.rlike(BAD_TEXT), "text")
    )


def rejected(raw: DataFrame) -> DataFrame:
    """``(line_no, reason)`` of the lines that do not load."""
    return parsed(raw).where("reason is not null").select("line_no", "reason")


def loaded(raw: DataFrame) -> DataFrame:
    """``(line_no, doc_id, url, title, text)`` of the lines that load; ``doc_id`` without byte order mark and outer white space."""
    fields = F.col("fields")
    return parsed(raw).where("reason is null").select(
        "line_no", doc_id_of(fields).alias("doc_id"), _value(fields, 1).alias("url"), _value(fields, 2).alias("title"), _value(fields, 3).alias("text")
    )
