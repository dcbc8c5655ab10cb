"""Tables of odd content, for the tests of all queries."""

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, venue string, added_at timestamp_ntz",
    "docs_file": "doc_id string, url string, title string, text string, loaded_at timestamp_ntz",
    "docs_raw": "line_no bigint, line string",
    "cord19_trec_covid_docs": "line_no bigint, doc_id string, title string, abstract string, text string",
    "queries_file": "query_id string, title string, description string, narrative string, loaded_at timestamp_ntz",
    "qrels_file": "line_no bigint, query_id string, doc_id string, rel int, judged_at timestamp_ntz, received_at timestamp_ntz",
    "run_file": "query_id string, iter int, doc_id string, score double",
    "postings_list": "term_id int, doc_id string, tf int",
    "removed_keys": "table_name string, key_value string, removed_at timestamp_ntz",
    "mix_targets": "source string, target_share double, max_repeats int",
    "name_list": "entry string, kind string",
}


def write(spark, folder, rows=None):
    """Every table of ``SCHEMAS`` with the rows given by its name, or none."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame((rows or {}).get(name, []), schema).write.parquet(f"{folder}/{name}.parquet")


def nulls(n=3):
    """Rows of nulls alone."""
    return {name: [(None,) * (schema.count(",") + 1)] * n for name, schema in SCHEMAS.items()}


def odd(repeats=1):
    """Empty, blank, very long and repeated values, and keys that hold most rows."""
    from datetime import datetime

    t = datetime(2021, 3, 1)
    texts = ["", " \n ", "One. Two (three. Four) five.\n\nMr. Osk called 202-555-0112.", "word " * 30_000, "x" * 70_000, "(" * 3000, "病毒。" * 3000, None]
    rows = {
        "documents": [(i, x, "en", s, None, None, t) for i, (x, s) in enumerate(zip(texts, ["a", "A ", None, "a", "b", "", "a", "c"]))],
        "docs_file": [(f"D{i:09}", None, "", x, t) for i, x in enumerate(texts)] + [(None, "u", "t", "No id. At all.", t)],
        "docs_raw": [(i, x) for i, x in enumerate([None, "", "D000000001\tu\tt\tok text", '"D000000001\tu', "\t\t\t", "a\tb\tc\td\te", "x" * 70_000, "D000000002\t\t\t \x01"])],
        "cord19_trec_covid_docs": [(i, d, None, None, x) for i, (d, x) in enumerate(zip([" A", "a", "b", "c", None, "d", "e", "f"], texts))],
        "queries_file": [("1", "t", None, "", t), ("1", "t", None, "", t), (None, None, None, None, None)],
        "qrels_file": [(i, " 1", "d000000001" if i % 3 else "gone", 1, t, t) for i in range(40)] + [(99, "", None, None, None, None)],
        "run_file": [("hot", 0, "same", 1.0)] * 60 + [("hot", 0, f"d{i}", float(i % 3)) for i in range(60)] + [("q", 0, "d", float("nan")), (None, 0, "d", 1.0), ("q", 0, None, 1.0)],
        "postings_list": [(1, f"d{i % 7} ", i) for i in range(50)] + [(2, "D1", None), (None, "d1", 1), (3, None, 1), (3, "", -(2**31))],
        "removed_keys": [("docs_file", "D000000001 ", t), ("other", "x", t), (None, None, None)],
        "mix_targets": [("a", 0.5, 2), ("b", 0.5, None), (None, 0.1, 1), ("gone", None, 3)],
        "name_list": [("Ana", "given"), ("Osk", "family"), ("", "given"), (None, None), ("Ana", "other")],
    }
    return {name: r * repeats for name, r in rows.items()}
