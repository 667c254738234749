import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from lanternspark.operators import metrics as M
from lanternspark.operators import perplexity
from lanternspark.sources import tables
from lanternspark.streaming.append import append_stream


def test_text_metrics(spark):
    d = spark.createDataFrame([(1, "the cat sat", "the cat sat"), (2, "a b c d", "d c b a"), (3, None, "x"), (4, "", "")], "id long, reference string, generated string")
    got = {r["id"]: r for r in M.text_metrics(d).collect()}
    assert got[1]["rouge1"] == got[1]["rouge2"] == got[1]["rougeL"] == got[1]["rougeLsum"] == 1.0
    assert got[2]["rouge1"] == 1.0 and got[2]["rouge2"] == 0.0 and got[2]["rougeL"] == 0.25
    assert got[3]["rouge1"] == got[4]["rougeL"] == got[4]["bleu"] == 0.0
    assert M.bleu("a b c d e".split(), "a b c d e".split()) == 1.0
    assert 0 < M.bleu("a b c d e f".split(), "a b c d e".split()) < 1
    assert M.tokens_13a("Size 3.5 cm, stable.") == ["Size", "3.5", "cm", ",", "stable", "."]


@pytest.mark.parametrize("w,s", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("agreed", "agre"), ("happy", "happi"), ("controlling", "control"), ("generalizations", "gener"), ("sky", "sky"), ("effective", "effect")])
def test_porter(w, s):
    assert M.PorterStemmer().stem(w) == s


def test_set_overlap_golden(spark):
    d = spark.createDataFrame([(["a"], ["a", "b"], ["b", "c"]), (None, None, None)], "p array<string>, r array<string>, g array<string>")
    x = M.set_overlap(d, "p", "r", "g").collect()
    assert [round(x[0][c], 6) for c in ("entity_jaccard_ref_gen", "entity_recall_ref_gen", "entity_precision_ref_gen")] == [0.333333, 0.5, 0.5]
    assert (x[0]["entity_neg_hallucination_flag"], x[0]["umls_new_concepts_count"]) == (1, 1)
    assert x[1]["entity_jaccard_ref_gen"] == 1.0 and x[1]["umls_hallucination_flag"] == 0


def test_summary_leaves_nan_out(spark):
    d = spark.createDataFrame([("m", 1.0), ("m", float("nan")), ("m", None), ("n", 3.0)], "model string, x double")
    assert rows(M.summary(d, "model").select("model", "rows", "x")) == [("m", 3, 1.0), ("n", 1, 3.0)]
    assert rows(M.perplexities(d, "model", {"self": "x"}).select("model", F.round("self_ppl", 6))) == [("m", 2.718282), ("n", 20.085537)]


def test_uniform_unigram_perplexity(spark):
    d = spark.createDataFrame([(1, "a b c d")], "id long, text string")
    c = perplexity.unigram_counts(d)
    assert abs(perplexity.unigram_perplexity(d, "id", "text", c).first()["ppl"] - 4.5) < 1e-9
    lab = perplexity.shifted_labels(spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "s long, pos int, token string"), ["s"])
    assert rows(lab.select("token", F.coalesce("label", F.lit("-")))) == [("a", "b"), ("b", "-")]


def test_csv_and_jsonl_round_trip(spark, tmp_path):
    d = spark.createDataFrame([('he said "x"\nthen, left', "1"), (None, "2")], "text string, id string")
    tables.write_csv(d, str(tmp_path / "c"))
    assert sorted(map(str, tables.read_csv(spark, str(tmp_path / "c")).collect())) == sorted(map(str, d.collect()))
    conv = spark.createDataFrame([([("user", "é\n"), ("assistant", None)],)], "messages array<struct<role:string,content:string>>")
    assert tables.write_conversations(conv, str(tmp_path / "j")) == 1
    got = tables.read_conversations(spark, str(tmp_path / "j")).first()["messages"]
    assert [(m["role"], m["content"]) for m in got] == [("user", "é\n"), ("assistant", None)]


def test_sources_errors_and_splits(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_many(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        tables.existing(spark, {"a": str(tmp_path / "no")})
    with pytest.raises(ValueError):
        tables.read_splits(spark, {"train": "x.xml"})
    (tmp_path / "a.csv").write_text("text\nx\n")
    (tmp_path / "b.csv").write_text("text\ny\n")
    assert rows(tables.read_many(spark, str(tmp_path)).select("text", "source_stem")) == [("x", "a"), ("y", "b")]
    assert rows(tables.read_splits(spark, {"train": str(tmp_path / "a.csv"), "validation": str(tmp_path / "b.csv")})) == [("x", "train"), ("y", "validation")]


def test_datastore_is_written_once(spark, tmp_path):
    d = spark.range(5).select(F.col("id").alias("key_id"), F.array(F.lit(1.0)).alias("key"), F.lit(1).alias("val"))
    p = str(tmp_path / "d")
    tables.write_datastore(d, p, cap=3)
    assert tables.read_datastore(spark, p, keys=False).columns == ["key_id", "val"] and tables.read_datastore(spark, p).count() == 3
    with pytest.raises(Exception):
        tables.write_datastore(d, p)


def test_stream_append(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in range(3):
        spark.range(part * 4, part * 4 + 4).selectExpr("id as at", "array(cast(id as double)) as key", "cast(id % 2 as int) as val").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("at long, key array<double>, val int").parquet(src)
        append_stream(stream, out, str(tmp_path / "cp"), "at", cap=10).awaitTermination()
    got = spark.read.parquet(out)
    assert rows(got.select("key_id", "at")) == [(i, i) for i in range(10)]
    assert os.path.isdir(out)


def test_lcs_length_is_that_of_the_table():
    import random

    r = random.Random(0)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(90))] for _ in range(2))
        assert M.lcs_length(a, b) == M.lcs_table(a, b)[-1][-1]


def test_max_cosine(spark):
    d = spark.createDataFrame([([[1.0, 0.0], [0.0, 2.0]], [[3.0, 0.0]]), ([], [[1.0, 0.0]]), (None, None), ([[0.0, 0.0]], [[1.0, 0.0]])], "a array<array<double>>, b array<array<double>>")
    got = [tuple(round(x, 6) for x in r[2:]) for r in M.max_cosine_scores(d, "a", "b").collect()]
    assert got == [(1.0, 0.5, 0.666667), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
