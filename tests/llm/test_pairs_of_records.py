"""Problems 1 and 4 against brute force, with dirt."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from conftest import rows
from lanternspark.llm import forest, queries as llm_queries, winnow

SCHEMA = "record_id long, source string, messages array<struct<role:string,content:string>>, cls string, words string, fp long"
WORDS = [f"w{i}" for i in range(400)]


def texts(seed, n):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        base = [r.choice(WORDS) for _ in range(r.choice((4, 9, 30, 90, 160)))]
        out.append(base)
        for _ in range(r.choice((0, 0, 1, 3))):
            t = list(base)
            for _ in range(len(t) // 25 + (r.random() < 0.5)):
                i = r.randrange(len(t))
                t[i : i + r.choice((0, 1))] = [r.choice(WORDS)]
            cut = r.randrange(len(t))
            out.append(t[cut:] + t[:cut] if r.random() < 0.2 else t)
    return [" ".join(t) for t in out]


def record(i, text, source="a"):
    w = text.split(" ")
    h = len(w) * 2 // 3
    return (i, source, [("system", "s"), ("user", " ".join(w[:h])), ("assistant", " ".join(w[h:]))], "clash", "clash", 1)


DIRT = [(900, None, [("user", None), ("assistant", None)], None, None, None), (901, "a", None, "x", "x", 1), (902, "a", [], "x", "x", 1), (903, "a", [("user", "only user"), ("assistant", None)], "x", "x", 1),
        (None, "a", [("user", "a b c d e f"), ("assistant", "g h")], "x", "x", 1), (904, "a", [("user", " \n "), ("assistant", "")], "x", "x", 1)]


def shingles(r, k):
    m = r[2] or []
    c = [next((x[1] or "" for x in m if x[0] == role), "") for role in ("user", "assistant")]
    w = re.findall(r"[^\W_]+", " ".join(c).lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def similar(a, b, k, least):
    x, y = shingles(a, k), shingles(b, k)
    return bool(x and y) and len(x & y) / len(x | y) >= least


def gap(pairs, k, lo, hi):
    """No pair between lo and hi: what the operators are told to rely on."""
    return [p for p in pairs if lo < len(shingles(p[0], k) & shingles(p[1], k)) / max(1, len(shingles(p[0], k) | shingles(p[1], k))) < hi]


def test_near_duplicates_are_found(spark):
    data = [record(i, t) for i, t in enumerate(texts(1, 60))]
    data = data + [data[3], data[7]] + [record(500 + i, " ".join(WORDS[:40])) for i in range(6)] + DIRT
    unsure = {p for a, b in gap(list(combinations({d[0]: d for d in data if d[0] is not None}.values(), 2)), 3, 0.4, 0.56) for p in [tuple(sorted((a[0], b[0])))]}
    want = {tuple(sorted((a[0], b[0]))) for a, b in combinations({d[0]: d for d in data if d[0] is not None}.values(), 2) if similar(a, b, 3, 0.5)}
    got = set(rows(forest.similar_records(spark.createDataFrame(data, SCHEMA).repartition(3), k=3, least=0.5)))
    assert got <= want and want - got <= unsure
    assert len([p for p in got if p[0] >= 500 and p[1] >= 500 and p[1] < 900]) == 15


def test_groups_hold_every_record(spark):
    data = [record(i, t) for i, t in enumerate(texts(2, 30))] + DIRT
    got = {r["record_id"]: r for r in forest.record_groups(spark.createDataFrame(data, SCHEMA)).collect()}
    every = {d[0]: d for d in data if d[0] is not None}
    assert set(got) == set(every)
    for a, b in combinations(every.values(), 2):
        if similar(a, b, 5, 0.8):
            assert got[a[0]]["group_id"] == got[b[0]]["group_id"]
    assert all(r["group_id"] <= r["class_id"] <= r["record_id"] for r in got.values())


@pytest.mark.parametrize("seed", [3, 4])
def test_overlap_across_splits(spark, seed):
    t = texts(seed, 60)
    train = [record(i, x) for i, x in enumerate(t) if i % 3] + DIRT
    held = [record(1000 + i, x) for i, x in enumerate(t) if i % 3 == 0] + [record(2000, t[1]), record(2001, t[1]), record(2001, t[1])]
    unsure = {(a[0], b[0]) for a, b in gap([(a, b) for a in train if a[0] is not None for b in held], 3, 0.4, 0.56)}
    want = {(a[0], b[0]) for a in train if a[0] is not None for b in held if similar(a, b, 3, 0.5)}
    got = set(rows(winnow.overlapping_records(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(held, SCHEMA))))
    assert got <= want and want - got <= unsure


def test_overlap_report(spark):
    t = texts(5, 10)
    train = spark.createDataFrame([record(i, x) for i, x in enumerate(t)] + DIRT, SCHEMA)
    held = spark.createDataFrame([record(100, t[0], None), record(101, "no such text at all here"), record(101, "no such text at all here")], SCHEMA).selectExpr("*", "'test' as split")
    r = {x["source"]: x for x in winnow.overlap_report(train, held).collect()}
    assert (r[None]["records"], r[None]["leaked"], r[None]["mean_coverage"]) == (1, 1, 1.0)
    assert (r["a"]["records"], r["a"]["leaked"], r["a"]["pairs"]) == (1, 0, 0)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(DIRT, SCHEMA)
    assert forest.similar_records(none).count() == 0 and forest.record_groups(none).count() == 0
    assert winnow.overlapping_records(none, some).count() == 0 and winnow.overlapping_records(some, none).count() == 0
    assert forest.similar_records(some, k=3, least=0.5).count() == 0


def test_prefixes_are_shortened_to_the_target(spark):
    none = spark.createDataFrame([], "words string")
    near, far = (forest.common_prefixes(none, 3, s, forest.TREES) for s in (0.8, 0.5))
    deep, short = (forest.depths_for(c, 2, 0.99) for c in (near, far))
    assert len(deep) < forest.TREES and set(deep) == {forest.LEVELS}
    assert len(short) == forest.TREES and set(short) <= {3, 4}
    assert forest.measured_recall(far, short, 2) >= 0.99 > forest.measured_recall(far, short + 1, 2)


@pytest.mark.parametrize("similarity", [0.5, 0.55, 0.6])
def test_recall_measured_on_texts(spark, similarity):
    """Pairs of texts with scattered substitutions that leave about the similarity; all that reach it are looked for."""
    words, data = 150, []
    edits = int((words - 2) * (1 - similarity) / (1 + similarity) / 3)
    for n in range(120):
        base, (version,) = family(1, words, edits, 1000 + n, even=True)
        data += [record(2 * n, base), record(2 * n + 1, version)]
    want = {(a[0], b[0]) for a, b in zip(data[::2], data[1::2]) if similar(a, b, 3, 0.5)}
    assert len(want) > 100
    got = set(rows(forest.similar_records(spark.createDataFrame(data, SCHEMA), k=3, least=0.5)))
    assert got <= want and len(got) >= 0.97 * len(want)


def test_very_long_texts(spark):
    r = random.Random(9)
    long = " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(60_000))
    data = [record(1, long), record(2, long + " one more word"), record(3, "short text of some five words")]
    assert rows(forest.similar_records(spark.createDataFrame(data, SCHEMA))) == [(1, 2)]
    assert rows(winnow.overlapping_records(spark.createDataFrame(data[:1], SCHEMA), spark.createDataFrame(data[1:], SCHEMA))) == [(1, 2)]


def family(n, words, edits, seed, even=False):
    """A text and n versions of it with substituted words: at random places, or spread evenly."""
    r = random.Random(seed)
    base = [f"f{seed}x{i}" for i in range(words)]
    out = []
    for v in range(n):
        t = list(base)
        step = words // edits
        at = range(v % step, words, step) if even else r.sample(range(words), edits)
        for i in at:
            t[i] = f"f{seed}v{v}x{i}"
        out.append(" ".join(t))
    return " ".join(base), out


def test_family_of_edited_held_out_versions(spark):
    base, versions = family(51, 120, 3, 1)
    train = [record(1, base), record(2, versions[50])]
    held = [record(1000 + i, v) for i, v in enumerate(versions[:50])]
    want = sorted((a[0], b[0]) for a in train for b in held if similar(a, b, 3, 0.5))
    assert len(want) == 100
    assert rows(winnow.overlapping_records(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(held, SCHEMA))) == want


@pytest.mark.parametrize("words", [20, 61, 120, 300])
def test_scattered_edits(spark, words):
    """One word changed in every 9 to 12: no run of more than 11 words is common."""
    train, held = [], []
    for step in (9, 10, 11, 12):
        for n in range(5):
            base, versions = family(step, words, max(1, words // step), 1000 * step + n, even=True)
            train.append(record(len(train), base))
            held += [record(1000 + len(held) + i, v) for i, v in enumerate(versions)]
    want = sorted((a[0], b[0]) for a in train for b in held if similar(a, b, 3, 0.5))
    assert len(want) > 50
    got = rows(winnow.overlapping_records(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(held, SCHEMA)))
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want)


def test_frequent_fingerprints_lose_no_pair(spark, monkeypatch):
    """Every fingerprint of a large family is frequent; blocks of few rows, so that there are several."""
    monkeypatch.setattr(winnow, "MANY", 20)
    monkeypatch.setattr(winnow, "BLOCK", 8)
    base, versions = family(80, 120, 6, 7)
    train = [record(i, v) for i, v in enumerate(versions[:40])] + [record(99, base + " " + " ".join(WORDS[:200]))]
    held = [record(1000 + i, v) for i, v in enumerate(versions[40:])] + [record(2000, " ".join(WORDS[50:130]))]
    want = sorted((a[0], b[0]) for a in train for b in held if similar(a, b, 3, 0.5))
    assert len(want) > 20
    for batch in (10_000, 11):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = rows(winnow.overlapping_records(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(held, SCHEMA)))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert set(got) <= set(want) and len(got) >= 0.99 * len(want)


def test_tiny_texts_overlap(spark):
    train = [record(1, "one two three"), record(2, "one two three four five"), record(3, "a b")]
    held = [record(11, "one two three"), record(12, "one two three four"), record(13, "a b"), record(14, "zero one two three four five")]
    want = sorted((a[0], b[0]) for a in train for b in held if similar(a, b, 3, 0.5))
    assert want and rows(winnow.overlapping_records(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(held, SCHEMA))) == want


def test_near_duplicates_at_the_lower_edge(spark, monkeypatch):
    data = []
    for n in range(80):
        base, (version,) = family(1, 120, 13, 100 + n)
        data += [record(2 * n, base), record(2 * n + 1, version)]
    want = sorted((a[0], b[0]) for a, b in zip(data[::2], data[1::2]) if similar(a, b, 3, 0.5))
    assert len(want) > 40
    df = spark.createDataFrame(data, SCHEMA)
    monkeypatch.setattr(llm_queries, "read", lambda *_: df)
    got = rows(llm_queries.p4_found(spark, ""))
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want)


def test_moved_blocks_overlap(spark):
    """Blocks of six or seven words in another order: no run of eight words is common, and long texts share no more than short ones."""
    train, held = [], []
    for n in range(60):
        for block, blocks in ((7, 9), (7, 17), (7, 40), (6, 300)):
            r = random.Random(len(train))
            w = [[f"b{len(train)}x{i}x{j}" for j in range(block)] for i in range(blocks)]
            train.append(record(len(train), " ".join(x for y in w for x in y)))
            r.shuffle(w)
            held.append(record(1000 + len(held), " ".join(x for y in w for x in y)))
    want = sorted((a[0], b[0]) for a, b in zip(train, held) if similar(a, b, 3, 0.5))
    assert len(want) > 200
    assert rows(winnow.overlapping_records(spark.createDataFrame(train, SCHEMA), spark.createDataFrame(held, SCHEMA))) == want


def test_few_words_in_any_order_overlap(spark):
    """Of texts over nine words, most sequences of three are common, and hardly any of five."""
    r = random.Random(5)
    data = [record(i, " ".join(r.choice("abcdefghi") for _ in range(2_500))) for i in range(40)]
    want = sorted((a[0], b[0]) for a in data[:20] for b in data[20:] if similar(a, b, 3, 0.5))
    assert len(want) == 400
    assert rows(winnow.overlapping_records(spark.createDataFrame(data[:20], SCHEMA), spark.createDataFrame(data[20:], SCHEMA))) == want


@pytest.mark.parametrize("many", [10**9, 0])
def test_rows_of_a_key_meet_as_by_brute_force(monkeypatch, many):
    monkeypatch.setattr(winnow, "MANY", many)
    monkeypatch.setattr(winnow, "BLOCK", 9)
    rng = np.random.default_rng(1)
    n = 600
    key, held = rng.integers(0, 4, n).astype(np.uint64), rng.random(n) < 0.4
    text = (np.arange(n) << 6) | rng.integers(20, 30, n)
    text[:50], key[:50], held[:50] = text[50:100], key[50:100], held[50:100]  # signed by two tasks
    byte = np.zeros((n, 16), np.uint8)
    byte[:, : winnow.BYTES] = rng.integers(0, 3, (n, winnow.BYTES))
    byte[:50] = byte[50:100]
    sketch = byte.view(np.uint64)
    want = {}
    for i in np.flatnonzero(~held):
        for j in np.flatnonzero(held):
            same = int((byte[i] == byte[j])[: winnow.BYTES].sum())
            if key[i] == key[j] and same >= winnow.AGREE and abs((text[i] & 63) - (text[j] & 63)) <= 4:
                want[int(text[i] >> 6), int(text[j] >> 6)] = same
    got = [tuple(map(int, x)) for part in winnow.met(key, held, text, sketch, 4) for x in zip(*part)]
    assert len(want) > 1_000 and sorted(got) == sorted((a, b, s) for (a, b), s in want.items())


def test_a_row_takes_21_bytes():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 1 << 40, 50)
    sketch = rng.integers(0, 2**64, (50, 2), dtype=np.uint64) & np.array([2**64 - 1, 2**32 - 1], np.uint64)
    key = np.sort(rng.integers(0, 2**32, 50, dtype=np.uint64))
    data = winnow._pack(key, text, sketch)
    assert len(data) == 50 * 21
    assert all((x == y).all() for x, y in zip(winnow._unpack(data), (key, text, sketch)))


def test_unlike_texts_rarely_meet():
    """Rows of one key whose texts are at similarity 0.15: few go on to be counted, so that their number stays small in large tables."""
    rng = np.random.default_rng(3)
    n = 400
    byte = np.zeros((n, 16), np.uint8)
    common = rng.integers(0, 256, winnow.BYTES)
    byte[:, : winnow.BYTES] = np.where(rng.random((n, winnow.BYTES)) < 0.4, common, rng.integers(0, 256, (n, winnow.BYTES)))  # two agree in 0.16
    got = sum(len(x) for x, _, _ in winnow.met(np.zeros(n, np.uint64), np.arange(n) % 2 == 1, np.arange(n) << 6, byte.view(np.uint64), 4))
    assert got < 0.2 * (n // 2) ** 2
