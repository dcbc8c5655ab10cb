from pathlib import Path

import pytest

from siltwork.llm import bpe, queries
from tests import edges

needs_vocabulary = pytest.mark.skipif(not (Path(bpe.TOKENIZERS) / bpe.VOCABULARY).exists(), reason="no public vocabulary here")


@needs_vocabulary
@pytest.mark.parametrize("rows", [None, edges.nulls(), edges.odd()], ids=["empty", "nulls", "odd"])
def test_text_queries(spark, tmp_path, rows):
    edges.write(spark, tmp_path, rows)
    got = {name: sorted(map(tuple, query(spark, str(tmp_path)).collect()), key=repr) for name, query in queries.QUERIES.items()}
    if rows is None:
        assert not any(got.values())
    elif len(rows["run_file"]) == 3:
        assert got.pop("p8_ids") == [(None, [])] * 3 and got.pop("p10_text") == [(None, None)] * 3
        assert not any(got.values())
    else:
        docs = {r[0]: r[3] for r in rows["docs_file"] if r[0] and r[3]}
        for d, a, b in got["p1_found"]:
            assert docs[d][a:b] == docs[d][a:b].strip() != ""
        assert {d: "".join("".join(docs[d][a:b] for x, a, b in sorted(got["p1_found"]) if x == d).split()) for d in docs} == {d: "".join(t.split()) for d, t in docs.items()}
        assert [r for r in got["p2_ranked"]] == [("hot", f"d{i}", 2.0, n) for n, i in enumerate(sorted((i for i in range(60) if i % 3 == 2), key=str, reverse=True)[:10], 1)] or len(got["p2_ranked"]) == 10
        assert dict(got["p6_found"]) == {"D000000003": 0, "D000000004": 1, "D000000005": 1, "D000000006": 0}
        assert len(got["p8_ids"]) == len(got["p10_text"]) == 8 and [len(i) for d, i in got["p8_ids"] if d in (0, 7)] == [0, 0]
        assert {r[1] for r in got["p10_found"]} == {"person", "phone"} and len({d for d, *_ in got["p10_found"]}) == 1
        assert {r[0] for r in got["p9_found"]} == {"b"}
