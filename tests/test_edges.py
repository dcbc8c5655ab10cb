import pytest

from siltwork.plans import general
from tests import edges


@pytest.mark.parametrize("rows", [None, edges.nulls(), edges.odd()], ids=["empty", "nulls", "odd"])
def test_general_queries(spark, tmp_path, rows):
    edges.write(spark, tmp_path, rows)
    got = {name: sorted(map(tuple, query(spark, str(tmp_path)).collect()), key=repr) for name, query in general.QUERIES.items()}
    if rows is None:
        assert not any(got.values())
    elif len(rows["run_file"]) == 3:
        assert got.pop("p5_found") == [(None, "columns")] * 3 and not any(got.values())
    else:
        assert got["p5_found"] == [(0, "columns"), (1, "columns"), (3, "quoting"), (4, "doc_id"), (5, "columns"), (6, "columns"), (7, "text")]
        assert [r[3] for r in got["p4_found"]] == ["2021-03"] * 40 and {r[2] for r in got["p4_found"]} == {"missing", "removed"}
        assert {r for r in got["p7_found"] if r[0] == "term_id"} == {("term_id", "1"), ("term_id", "2"), ("term_id", "3")}
        again = tmp_path / "again"
        edges.write(spark, again, edges.odd(2))
        for name in ("p7_found", "p4_report"):  # repeated rows are one pair, but two references
            twice = sorted(map(tuple, general.QUERIES[name](spark, str(again)).collect()), key=repr)
            assert twice == (got[name] if name == "p7_found" else [(*r[:3], 2 * r[3]) for r in got[name]])
