import json

import pytest

from siltwork.cli import main


def test_pipeline(spark, tmp_path):
    path = lambda name: str(tmp_path / name)
    put = lambda name, lines: (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    text = lambda name: [r[0] for r in spark.read.text(path(name)).collect()]
    docs = [{"doc_id": f"D{i}", "title": f"word{i % 3}", "abstract": "virus lung virus" if i % 2 else "mask"} for i in range(8)] + [{"doc_id": "d0", "title": "again", "abstract": ""}, {"title": "no id"}]
    put("corpus", map(json.dumps, docs))
    put("queries", [json.dumps({"query_id": "Q1", "title": "virus", "description": "word1", "narrative": "x"})])
    main(["clean", path("corpus"), path("clean")], spark)
    assert len(text("clean")) == 8
    for kind in ("0", "1", "2"):
        main(["dictionary", path("corpus"), kind, path("dict" + kind)], spark)
        main(["index", path("corpus"), path("index" + kind), kind], spark)
        main(["search", path("queries"), path("run" + kind), path("index" + kind), "--k", "5"], spark)
        assert len(text("run" + kind)) == 5 and text("run0")[0].startswith("q1\t0\td")
    with pytest.raises(ValueError, match="tokenizer type 7"):
        main(["dictionary", path("corpus"), "7", path("no")], spark)

    put("docs.tsv", [f"d{i}\tu\tt\tOne{i} virus here. Two. Three. Four" for i in range(4)])
    put("train.tsv", ["1\tlung care", "2\tmask use"])
    put("tests.tsv", ["9\tvirus load"])
    put("qrels", ["1 d0 1 0", "1 d1 2 0", "2 d2 1 0", "9 d0 2 0", "9 d3 0 0"])
    for how in ("diverse", "random"):
        main([f"{how}-passages", path("docs.tsv"), path("train.tsv"), path("qrels"), path(how)], spark)
        assert text(how) and all("\t" in x for x in text(how))
    put("top", ["9\td0\t1", "9\td3\t2", "1\td1\t1", "2\td2\t1"])
    main(["expand", path("diverse"), path("tests.tsv"), path("gen")], spark)
    main(["expand-disjoint", path("diverse"), path("tests.tsv"), path("train.tsv"), path("top"), path("gen2")], spark)
    assert len(text("gen")) == len(text("gen2")) == 5
    put("plain.tsv", [f"d{i}\tvirus load {i}" if i else "d0\tvirus virus load" for i in range(4)])
    main(["preprocess", path("plain.tsv"), path("pre")], spark)
    main(["score", path("pre"), path("gen"), path("top"), path("qrels"), path("report")], spark)
    assert len(text("report")) == 15
    put("lemmas", ["virus\tviri"])
    main(["preprocess", path("plain.tsv"), path("pre2"), "--lemmas", path("lemmas")], spark)
    assert "d0\tviri viri load" in text("pre2")
    main(["score", path("pre"), path("gen"), path("top"), path("qrels"), path("report2"), "--ranking", path("ranking"), "--preprocess-query"], spark)
    assert {x.split("\t")[2] for x in text("ranking")} == {"1", "2"} and len(text("ranking")) == 10
