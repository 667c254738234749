import json

import pytest

from lanternspark.plans.config import Retrieval
from lanternspark.sources import convert
from lanternspark.sources.tables import read_conversations


def test_convert_folder_reports_failures(spark, tmp_path):
    (tmp_path / "a.csv").write_text('context,impression\n" c1 ",a1\n"c2\nmore",\n')
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    (tmp_path / "empty.csv").write_text("context,impression\n")
    (tmp_path / "note.txt").write_text("no")
    got = {r["file"]: r for r in convert.convert_folder(spark, str(tmp_path), str(tmp_path / "out"), finetune=True).collect()}
    assert set(got) == {"a.csv", "bad.csv", "empty.csv"}
    assert got["a.csv"]["rows"] == 2 and got["a.csv"]["error"] is None
    assert got["bad.csv"]["error"] and got["empty.csv"]["error"] == "no rows"
    m = sorted(tuple(x["content"] for x in r["messages"][1:]) for r in read_conversations(spark, got["a.csv"]["output"]).collect())
    assert m == [("c1", "a1"), ("c2\nmore", "")]


def test_convert_with_metadata(spark, tmp_path):
    (tmp_path / "d.csv").write_text("ID,Dialogue, Note,ICD10,ICD10_desc\n1,hello,n1,A1,x\n2,bye,n2,B2,y\n")
    assert convert.convert_csv(spark, str(tmp_path / "d.csv"), str(tmp_path / "o"), convert.CODED_DIALOGUES) == 2
    r = read_conversations(spark, str(tmp_path / "o")).collect()
    assert sorted(x["metadata"]["icd10"] for x in r) == ["A1", "B2"]
    assert all(len(x["messages"]) == 5 and x["messages"][2]["content"] != x["messages"][4]["content"] for x in r)


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"k": 8, "metric": "DOT"}))
    assert Retrieval.from_json(str(tmp_path / "c.json")).metric == "dot"
    c = Retrieval.from_text("k=5,weight=0.5,no_pointer=true")
    assert (c.k, c.weight, c.no_pointer) == (5, 0.5, True) and c.as_dict()["nprobe"] == 32
    for bad in ("metric=cos", "nope=1", "weight=2"):
        with pytest.raises(ValueError):
            Retrieval.from_text(bad)
