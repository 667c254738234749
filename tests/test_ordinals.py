import hashlib

import pytest

from conftest import rows
from lanternspark.operators import ordinals as O


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "doc_id").repartition(7)


@pytest.mark.parametrize("n", [0, 1, 10, 137])
def test_ordinal_is_dense_and_ordered(spark, n):
    got = rows(O.ordinal(ids(spark, n), "doc_id"))
    assert got == [(i, i) for i in range(n)]


@pytest.mark.parametrize("n", [1, 7, 10, 101])
def test_split_sizes_are_exact(spark, n):
    got = dict(rows(O.split_three(ids(spark, n), "doc_id").groupBy("split").count()))
    held = -(-n // 5)
    test = -(-held // 2)
    assert got == {k: v for k, v in {"test": test, "val": held - test, "train": n - held}.items() if v}


def test_split_order_is_md5(spark):
    got = {r[0]: r[1] for r in O.split_three(ids(spark, 50), "doc_id").collect()}
    order = sorted(range(50), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    assert all(got[i] == "test" for i in order[:5]) and all(got[i] == "val" for i in order[5:10])


def test_nested_samples_are_prefixes(spark):
    s = O.nested_samples(ids(spark, 210), "doc_id")
    by = {}
    for d, p in rows(s):
        by.setdefault(p, set()).add(d)
    assert {p: len(v) for p, v in by.items()} == {p: round(210 * p / 100) for p in O.PERCENTS}
    assert all(by[a] <= by[b] for a, b in zip(O.PERCENTS, O.PERCENTS[1:]))


def test_head_tail_offset_latest_sample(spark):
    assert rows(O.head_tail(ids(spark, 40), "doc_id").where("split = 'validation'")) == [(0, "validation"), (1, "validation")]
    assert [r[0] for r in rows(O.offset_limit(ids(spark, 9), "doc_id", offset=2, limit=3))] == [2, 3, 4]
    d = spark.createDataFrame([(1, 5, "b"), (1, 3, "a"), (2, None, "c"), (None, 1, "x")], "k long, at long, v string")
    assert rows(O.latest(d, "k", "at").select("k", "v")) == [(1, "a"), (2, "c")]
    assert O.bounded_sample(ids(spark, 900), "doc_id", 20).count() == 20
    assert rows(O.bounded_sample(ids(spark, 900), "doc_id", 20)) == rows(O.bounded_sample(ids(spark, 900).repartition(3), "doc_id", 20))
