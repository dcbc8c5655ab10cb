"""Functions for SQL: ``analyze_simple``, and encoders over a learned vocabulary."""

from __future__ import annotations

from pyspark.sql import SparkSession

from siltwork.functions.text import STRICT
from siltwork.operators.vocabularies import Vocabulary, encoder

#: Names of the encoders by the kind of their vocabulary.
ENCODERS = {"bpe": "bpe_encode", "wordpiece": "wordpiece_encode"}


def register(spark: SparkSession, *vocabularies: Vocabulary) -> list[str]:
    """Registers ``analyze_simple(text)``, an SQL expression, and for each vocabulary ``bpe_encode(words)`` or
    ``wordpiece_encode(words)``, an Arrow function of an array of words; gives the names registered."""
    cut = "[" + "".join(f"\\\\x{ord(c):02x}" for c in STRICT) + "]"
    body = f"filter(split(lower(regexp_replace(coalesce(text, ''), '[^\\\\x00-\\\\x7F]', '')), '{cut}'), x -> x <> '')"
    spark.sql(f"create or replace temporary function analyze_simple(text string) returns array<string> return {body}")
    names = ["analyze_simple"]
    for v in vocabularies:
        spark.udf.register(ENCODERS[v.kind], encoder(v))
        names.append(ENCODERS[v.kind])
    return names
