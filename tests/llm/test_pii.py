"""Problem 5: held-out accuracy, and defined results for dirt."""

import re
from collections import Counter

import numpy as np
import pytest

from lanternspark.llm import pii as P
from lanternspark.llm import pii_table


#: words that any corpus knows
VOCABULARY = {w: 1 for t in (pii_table.LINES, pii_table.OTHERS, *(x.split("|") for x in (pii_table.PARTS, pii_table.FINDINGS, pii_table.SYMPTOMS, pii_table.STUDIES, pii_table.EPONYMS))) for x in t for w in re.findall(r"[^\W\d_]+", re.sub(r"\{.*?\}", " ", x))}


@pytest.fixture(scope="module")
def field():
    return P.train(VOCABULARY)


def test_held_out_lines():
    """Trained on four fifths of the lines, tested on sentences made of the others only."""
    part = lambda t, held: tuple(x for i, x in enumerate(t) if (i % 5 == 2) == held)
    field = P.train(VOCABULARY, lines=part(pii_table.LINES, False), others=part(pii_table.OTHERS, False))
    data = pii_table.labelled_texts(600, 77, part(pii_table.LINES, True), part(pii_table.OTHERS, True))
    texts = ["".join(t for t, _ in p) for p in data]
    right, wrong, missed = Counter(), Counter(), Counter()
    for pieces, found in zip(data, field.find(texts)):
        want, got = {k for _, k in pieces if k in pii_table.TYPES}, {k for k, _, _ in found}
        right.update(want & got), wrong.update(got - want), missed.update(want - got)
    print({k: (round(right[k] / (right[k] + missed[k]), 3), round(right[k] / max(1, right[k] + wrong[k]), 3)) for k in pii_table.TYPES})
    assert right.total() / (right.total() + missed.total()) > 0.85 and right.total() / (right.total() + wrong.total()) > 0.9


@pytest.mark.parametrize("text", [
    "Łukasz Wałęsa was seen for pain.", "we spoke to Šime Čović today.", "dr. Иван Петров will call.", "Oliver Thompson consented to the biopsy.", "brother Tom Baker drove them home.", "Maria Gonzalez, who lives alone, has fever."])
def test_names_of_any_script(field, text):
    assert "[NAME]" in P.redact(text, field.find([text])[0])


def test_whole_values(field):
    assert P.redact("James O'Connor signed.", field.find(["James O'Connor signed."])[0]) == "[NAME] signed."
    assert "020 7946" not in P.redact("phoned from 020 7946 0958 at 10:15.", field.find(["phoned from 020 7946 0958 at 10:15."])[0])
    assert "foo" not in P.redact("write to foo.bar-baz@some.host-name.example now.", field.find(["write to foo.bar-baz@some.host-name.example now."])[0])


@pytest.mark.parametrize("text,want", [
    ("referred by dr anna novak. call back number 212-555-0116.", "referred by dr [NAME]. call back number [PHONE]."),
    ("send report to anna.novak@mail.example once signed.", "send report to [EMAIL] once signed."),
    ("contrast lot 10235412. discussed with dr. at the time of reading. findings could reflect crohn disease.", None),
    ("uptake in the right hip reaches 3.1, against 4.2 on 2015-03-02.", None),
])
def test_redaction(field, text, want):
    assert P.redact(text, field.find([text])[0]) == (want or text)


def test_viterbi_is_exhaustive(field):
    r = np.random.default_rng(0)
    score = r.normal(size=(7, len(P.LABELS))).astype(np.float32)
    text = np.array([0, 0, 0, 0, 1, 1, 2])
    got = field.decode(score, text)
    from itertools import product

    for t in range(3):
        own = score[text == t]
        best = max(product(range(len(P.LABELS)), repeat=len(own)), key=lambda y: sum(own[i, a] for i, a in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
        assert tuple(got[text == t]) == best


def test_find_pii_rows(spark):
    data = [("t", 1, "user", "mail anna.novak@mail.example"), ("t", 2, "user", None), ("t", None, "user", ""), ("t", 3, None, "日本語 " * 5000 + "naïve"), ("t", 1, "user", "mail anna.novak@mail.example")]
    df = spark.createDataFrame([(*d, "clash") for d in data], "table_name string, row_id long, place string, text string, found string")
    got = P.find_pii(df).collect()
    assert len(got) == 5
    by = {(r["row_id"], r["place"]): r for r in got}
    assert by[2, "user"]["redacted"] is None and by[2, "user"]["found"] == []
    f = by[1, "user"]["found"][0]
    assert (f["type"], f["value"]) == ("email", data[0][3][f["start"] : f["stop"]])
    assert P.find_pii(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [400, 4000])
def test_common_words_are_a_share_of_all_texts(spark, n):
    data = [(i, f"The chest{' effusion' * 2 if i % 50 == 0 else ''}{' novak' if i % 400 == 1 else ''} 42x") for i in range(n)] + [(n, None), (n + 1, "")]
    got = P.common_words(spark.createDataFrame(data, "row_id long, text string"))
    assert {w for w, level in got.items() if level == 2} == {"the", "chest", "effusion", "x"}
    assert got.get("novak") == (1 if n == 4000 else None)
