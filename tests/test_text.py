import pytest
from pyspark.sql import functions as F

from lanternspark.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r")).first()[0]


REPORTS = [
    ("x", ("x", "impression:")),
    ("impression: a impression: b", ("impression: a impression: b", "impression:")),
    ("nonimpression: y", ("nonimpression: y", "impression:")),
    ("impression:", ("", "impression: ")),
    ("EXAMINATION:  CHEST ___ |\n IMPRESSION:  No acute process. ", ("examination: chest", "impression: no acute process.")),
    ("", ("", "impression:")),
    (None, (None, "impression:")),
    ("a ~~~ ### b\r\nImpression:\tc", ("a b", "impression: c")),
]


@pytest.mark.parametrize("text,want", REPORTS)
def test_report_sections(spark, text, want):
    got = one(spark, text, T.report_sections)
    assert tuple(got) == want


@pytest.mark.parametrize("text,blank", [("impression:", True), ("impression: ", True), (" impression:\n", True), ("impression: x", False), (None, False), ("", False)])
def test_blank_impression(spark, text, blank):
    assert one(spark, text, T.is_blank_impression) is blank


@pytest.mark.parametrize("text,strict,loose", [("Impression :", True, False), ("impression:", True, True), (" ", True, True), ("", True, True), (None, True, True), ("Impression: ok", False, False)])
def test_invalid_reference(spark, text, strict, loose):
    assert one(spark, text, T.is_invalid_reference) is strict
    assert one(spark, text, lambda c: T.is_invalid_reference(c, ":;.,")) is loose


def test_small_helpers(spark):
    assert one(spark, "/a/b/c.d.csv", T.file_stem) == "c.d"
    assert one(spark, "a=1,b=2", T.config_map) == {"a": "1", "b": "2"}
    assert one(spark, "Ab-12 c", T.tokens) == ["ab", "12", "c"]
    assert one(spark, None, T.tokens) == []
    assert one(spark, "abc  ", lambda c: T.strip(c)) == "abc"
    assert one(spark, "prompt  answer ", lambda c: T.continuation(c, F.lit("prompt"))) == "answer"
