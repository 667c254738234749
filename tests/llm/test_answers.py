"""Problems 2 and 3."""

import random

import pytest

from conftest import rows
from lanternspark.llm import answers as A
from lanternspark.llm import truncation as T

SCHEMA = "gen_id long, record_id long, run_id string, source string, prompt string, reference string, generated string, row_id long, text string, defect string"


def row(i, prompt, reference, generated, source="a"):
    return (i, 1, "r", source, prompt, reference, generated, 5, "clash", "clash")


@pytest.mark.parametrize("text,empty", [(None, True), ("", True), (" \n", True), ("impression:", True), ("IMPRESSION - n/a", True), ("___", True), ("(no text)", True), ("...", True), ("null", True),
                                        ("impression: normal", False), ("no change.", False), ("none of these.", False)])
def test_empty(text, empty):
    assert A.is_empty(text) is empty


@pytest.mark.parametrize("text,found", [
    ("I'm sorry, but I can't give a diagnosis.", True), ("this assistant does not comment on scans", True), ("As a language model I am not able to help.", True), ("Request denied: policy does not allow me to.", True),
    ("it would not be appropriate for me to write this", True), ("the left lung could not be assessed, sorry for the delay in reading.", False), ("patient refused contrast because of fever", False),
    ("I have no way of reading this study for you.", True), ("We are not permitted to share an opinion here.", True), ("Leider: tut mir leid, das geht nicht.", True),
    ("patient stated i cannot lie flat; views are limited", False), ("the patient said i will not stay for contrast", False), ("he told us i can't give more blood", False),
    ("I could not see a fracture.", False), ("We do not see a mass.", False), ("clinician declined further CT of the hip", False), ("unable to assess the hilum fully because of mass", False), ("the hip cannot be evaluated", False)])
def test_refusal(text, found):
    assert A.Refusals()(text) is found


def test_suffix_automaton_is_brute_force():
    r = random.Random(0)
    for _ in range(60):
        p, a = ([r.choice("abc") for _ in range(r.randrange(30))] for _ in range(2))
        got = A.SuffixAutomaton(p).matches(a)
        joined = {tuple(p[i:j]) for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        assert got == [max([0, *(n for n in range(1, i + 2) if tuple(a[i + 1 - n : i + 1]) in joined)]) for i in range(len(a))]


@pytest.mark.parametrize("text,lang", [("the cyst of the left kidney is stable", "en"), ("Kein weiterer auffälliger Befund im Milzhilus.", "de"), ("Patient de 40 ans souffrant depuis 3 jours, région lobe.", "fr"),
                                       ("En páncreas existe una masa de 19,3 cm.", "es"), ("probable pneumonia", None), ("", None)])
def test_language(text, lang):
    assert A.language(text, A._votes()) == lang


PROMPT = "examination of the left hip with a large cyst and the fracture of the neck is seen near the joint in this patient who fell from a ladder two days ago"


def test_defects_of_answers(spark):
    data = [
        row(1, PROMPT, "impression:", " ".join(PROMPT.split()[:22]) + "."),
        row(2, PROMPT, "stable cyst of the hip.", "I cannot give a diagnosis."),
        row(3, PROMPT, None, "Kein weiterer auffälliger Befund im rechten Knie und in der Hüfte."),
        row(4, None, "ok then.", "Kein weiterer Befund im Knie."),
        row(5, " ", "fine.", "fine."),
        row(3, PROMPT, None, "Kein weiterer auffälliger Befund im rechten Knie und in der Hüfte."),
        row(None, PROMPT, None, None),
    ]
    got = rows(A.defects(spark.createDataFrame(data, SCHEMA)))
    assert got == [(1, "generated", "copy"), (1, "reference", "empty"), (2, "generated", "refusal"), (3, "generated", "other_language"), (3, "reference", "empty")]
    assert A.defects(spark.createDataFrame([], SCHEMA)).count() == 0


def corpus():
    r = random.Random(5)
    parts = ["left kidney", "right hip", "distal ureter", "aortic arch", "medial thalamus", "splenic hilum"]
    things = ["calcification", "fracture", "stenosis", "effusion", "hematoma"]
    forms = [lambda: f"no acute process; {r.choice(things)} at the {r.choice(parts)} as described.", lambda: f"interval growth of the {r.choice(parts)} {r.choice(things)}, now {r.randrange(9)}.{r.randrange(9)} cm.",
             lambda: f"stable {r.choice(things)} near the {r.choice(parts)}.", lambda: f"cannot exclude {r.choice(things)} in the {r.choice(parts)}; correlate with fever."]
    return lambda n: " ".join(r.choice(forms)() for _ in range(n))


def test_truncation(spark):
    make = corpus()
    data = [row(i, None, make(4), "impression: " + make(4)) for i in range(300)]
    cases = {
        1000: "impression: stable fracture near the left kidney. stable calcifi",
        1001: "stable fracture near the right hip. interval growth of the",
        1002: "no acute process; effusion at the aortic arch",
        1003: "stable effusion near the distal ureter. cannot exclude stenosis in the right hip; correlate",
        1004: "stable effusion near the distal ureter, (see",
        1005: "stable effusion near the [...]",
    }
    fine = {2000: "stable effusion near the distal ureter", 2001: "impression: no acute process; fracture at the right hip as described", 2002: "interval growth of the right hip effusion, now 3.1 cm", 2003: "impression:", 2004: "stable fracture near the aortic arch, best seen on image 46."}
    data += [row(i, None, None, t) for i, t in {**cases, **fine}.items()]
    cut = [row(3000 + i, None, None, make(12)[:200].rstrip(".") + "x", "limited") for i in range(12)] + [row(3100 + i, None, None, make(2), "limited") for i in range(12)]
    df = spark.createDataFrame(data + cut, SCHEMA).repartition(3)
    got = {r["row_id"]: r for r in T.truncated(df, "gen_id", ("generated",), other_text=("reference",)).collect()}
    assert set(cases) <= set(got) and not set(fine) & set(got)
    assert all(got[3000 + i]["by_length"] for i in range(12)) and not any(3100 + i in got for i in range(12))
    assert not any(i < 300 for i in got)
    rate = {r["source"]: r for r in T.truncation_rates(df, "gen_id", "generated", other_text=("reference",)).collect()}
    assert (rate["limited"]["texts"], rate["limited"]["truncated"]) == (24, 12)


def test_lengths_by_chance_are_no_limit(spark):
    """A large source whose texts lack closing periods has many texts of each length; its tail is no pile."""
    r = random.Random(1)
    data = [row(i, None, None, "stable cyst near the hip " + "a" * r.randrange(1, 40), "loose") for i in range(4000)] + [row(9000 + i, None, None, "b" * 99, "tight") for i in range(5)]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("gen_id as row_id", "'generated' as text_column", "source", "generated as text")
    assert rows(T.limits(df, T._unfinished(df))) == [("generated", "tight", 99)]


def test_truncation_edges(spark):
    assert T.truncated(spark.createDataFrame([], SCHEMA), "gen_id", ("generated",)).count() == 0
    d = spark.createDataFrame([row(1, None, None, None, None), row(2, None, None, " ", None), row(3, None, None, "x" * 200_000, None)], SCHEMA)
    assert T.truncated(d, "gen_id", ("generated",)).count() == 0
    assert T.open_delimiter("a (b [c] d") and not T.open_delimiter("a (b) [c]") and T.open_delimiter('he said "so')
