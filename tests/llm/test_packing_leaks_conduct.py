"""Problems 6, 7 and 8."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from lanternspark.llm import conduct as C
from lanternspark.llm import fmindex as X
from lanternspark.llm import packing as K


def test_first_fit_is_first_fit():
    r = random.Random(0)
    for _ in range(40):
        cap = r.randrange(1, 30)
        sizes = sorted((r.randrange(1, cap + 1) for _ in range(r.randrange(1, 60))), reverse=True)
        room, want = [], []
        for s in sizes:
            i = next((i for i, x in enumerate(room) if x >= s), len(room))
            if i == len(room):
                room.append(cap)
            room[i] -= s
            want.append(i)
        assert K.first_fit(sizes, cap) == want


def test_packing_rules(spark):
    r = random.Random(1)
    sizes = [(i, r.choice((0, 1, 5, 40, 100, 250, 999))) for i in range(500)]
    caps = spark.createDataFrame([("a", 100), ("b", 256), (None, None), ("c", 0)], "config_name string, block_size int")
    got = K.pack(spark.createDataFrame(sizes, "id long, tokens long"), caps, group_docs=120).collect()
    for name, cap in (("a", 100), ("b", 256)):
        own = [g for g in got if g["config_name"] == name]
        fill, parts = {}, {}
        for g in own:
            fill[g["block"]] = fill.get(g["block"], 0) + g["tokens"]
            parts.setdefault(g["id"], []).append((g["start"], g["tokens"], g["piece"]))
        assert max(fill.values()) <= cap
        for i, n in sizes:
            p = sorted(parts.get(i, []))
            assert sum(x[1] for x in p) == n and [x[2] for x in p] == list(range(len(p)))
            assert all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:]))
            assert len(p) == (0 if n == 0 else 1 if n <= cap else -(-n // cap))
    assert {g["config_name"] for g in got} == {"a", "b"}
    assert K.pack(spark.createDataFrame([], "id long, tokens long"), caps).count() == 0


def test_token_sizes_and_fill(spark):
    d = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a " * 3000)], "doc_id long, text string")
    assert rows(K.token_sizes(d))[:3] == [(1, 2), (2, 0), (3, 0)]
    f = K.fill_rates(K.pack_documents(d, spark.createDataFrame([("x", 64)], "config_name string, block_size int"))).first()
    assert f["blocks"] >= f["least_blocks"] and 0.9 < f["fill"] <= 1


def test_fm_index_counts_and_locates():
    r = np.random.default_rng(0)
    for _ in range(30):
        size = int(r.integers(2, 9))
        code = np.append(r.integers(0, size, int(r.integers(1, 200))), 0)
        f = X.FMIndex(code, size)
        for n in (1, 2, 4):
            pats = r.integers(1, size, (20, n))
            lo, hi = f.search(pats)
            for p, a, b in zip(pats, lo, hi):
                want = [i for i in range(len(code) - n + 1) if (code[i : i + n] == p).all()]
                assert sorted(f.locate(np.arange(a, b)).tolist()) == want


def test_repeated_documents_in_a_shard():
    words = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(words[:12])), (2, "one two three"), (3, " ".join(words[10:30]))]
    docs = [words] * 200 + [["x"], [], words[3:9]]
    got = X.search_shard(docs, items, 4)
    assert sum(g[1] == 0 for g in got) == 201 and all(g[1] != 1 for g in got)
    assert got[0][2:] == (9, [(0, 12)])


def test_leaks_are_brute_force(spark):
    r = random.Random(3)
    words = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice((3, 10, 40))))) for i in range(12)] + [(50, None), (51, ""), (None, "a b c d e")]
    docs = []
    for i in range(80):
        t = [r.choice(words + ["zz", "Ünï"]) for _ in range(r.randrange(60))]
        if i % 3 == 0:
            own = items[i % 12][1].split()
            t[5:5] = own[: max(4, len(own) * 2 // 3)]
        docs.append((i, "  ".join(t).upper() if i % 2 else ", ".join(t), "clash", "clash"))
    docs += [(80, None, "c", "c"), (81, " ", "c", "c"), docs[0]]
    got = set(rows(X.leaked(spark.createDataFrame(docs, "doc_id long, text string, words string, item_id string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id")))
    four = lambda t: {tuple(w[i : i + 4]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 3)}
    want = {(d[0], i) for d in docs for i, t in items if i is not None and four(t) and len(four(t) & four(d[1])) >= 0.25 * len(four(t))}
    assert got == want and got
    at_once, X.ITEMS_AT_ONCE = X.ITEMS_AT_ONCE, 3  # several blocks of items give the same
    try:
        assert set(rows(X.leaked(spark.createDataFrame(docs, "doc_id long, text string, words string, item_id string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id"))) == want
    finally:
        X.ITEMS_AT_ONCE = at_once
    none = spark.createDataFrame([], "doc_id long, text string")
    assert X.leaked(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert X.leaked(spark.createDataFrame(docs, "doc_id long, text string, words string, item_id string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("a,b", [("only a shiiithead", "only a shithead"), ("you c.o.w.a.r.d", "you coward"), ("a mоrоn", "a moron"), ("m1s3rable", "miserable"), ("bas​tard", "bastard"), ("ID$IOT", "idsiot"), ("imbÃ©cil", "imbecil")])
def test_disguises(a, b):
    assert C.plain([a]).tobytes() == C.plain([b]).tobytes()


@pytest.fixture(scope="module")
def model():
    return C.fit([], [])


def test_table_alone_separates_and_swaps_agree(model):
    w, bias = model
    p = C.document_scores([s for _, s in C.SENTENCES], w, bias)
    y = np.array([v for v, _ in C.SENTENCES])
    assert (p[y == 1] > 0.4).mean() > 0.95 and (p[y == 0] < 0.4).mean() > 0.95
    neutral = C.document_scores([f"the clinic offers care for {t}" for t in ("immigrants", "patients", "muslims", "farmers", "gay people")], w, bias)
    assert neutral.max() < 0.4 and neutral.max() - neutral.min() < 0.3


def test_other_words(model):
    """Sentences that the table doesn't have."""
    w, bias = model
    bad = ["you utter halfwit", "someone ought to break his legs", "teachers are parasites", "she is a lazy, stinking liar", "hindus should be deported"]
    good = ["teachers were vaccinated last week", "his leg was broken in a fall", "hindus took part in our study"]
    assert (C.document_scores(bad, w, bias) > 0.4).all() and (C.document_scores(good, w, bias) < 0.4).all()


@pytest.mark.parametrize("before", [180, 200, 214, 219, 230, 330])
def test_no_cut_divides_an_insult(model, before):
    w, bias = model
    text = ("small cyst of the left hip near the neck " * 20)[:before] + " you are a complete idiot " + "and the cyst of the hip is stable " * 10
    assert C.document_scores([text], w, bias)[0] > 0.4


def test_worst_passage_decides(model):
    w, bias = model
    calm = "The left kidney is normal. No mass is seen. "
    p = C.document_scores([calm * 40, calm * 20 + "You are a complete idiot. " + calm * 20, "", "   ", "." * 5000, "a" * 30_000], w, bias)
    assert p[1] > 0.4 > max(p[0], *p[2:])


def test_scores_and_rates(spark):
    d = spark.createDataFrame([(1, "You are a complete idiot.", "a", 0.1), (2, "No mass is seen.", None, 0.1), (3, None, "a", 0.1), (1, "You are a complete idiot.", "a", 0.1)], "doc_id long, text string, source string, score double")
    v = spark.createDataFrame([(1, "r", "abusive"), (2, "r", "none"), (3, "r", None), (None, "r", "none")], "doc_id long, rater string, rating string")
    s = C.score_documents(d, v)
    got = {r["doc_id"]: r["score"] for r in s.collect()}
    assert got[1] > 0.4 > max(got[2], got[3]) and s.count() == 4
    rate = {r["source"]: r for r in C.review_rates(s).collect()}
    assert rate["a"]["to_review"] == 2 and rate[None]["rate"] == 0.0
    assert C.score_documents(d.limit(0), v.limit(0)).count() == 0
