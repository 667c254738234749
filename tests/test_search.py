import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from lanternspark.functions.probability import interpolate, safe_div
from lanternspark.sources import tables
from lanternspark.operators import ann, automaton, knnlm


def vectors(spark, n=200, dim=8, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return x, spark.createDataFrame([(i, [float(v) for v in r], i % 5) for i, r in enumerate(x)], "key_id long, key array<float>, val int").repartition(3)


@pytest.mark.parametrize("metric", ["l2", "dot"])
def test_exact_search_is_brute_force(spark, metric):
    x, s = vectors(spark)
    q = s.where("key_id % 20 = 0").select(F.col("key_id").alias("qid"), F.col("key").alias("qv"))
    got = {}
    for r in ann.exact_search(q, s, 7, metric).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["key_id"])
    y = x.astype(float)
    for i in range(0, 200, 20):
        d = ((y - y[i]) ** 2).sum(1) if metric == "l2" else -(y @ y[i])
        assert got[i] == list(np.lexsort((np.arange(200), d))[:7])


def test_search_edge_cases(spark):
    s = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, None, 1), (2, [1.0], 1), (3, [1.0, 0.0], 2)], "key_id long, key array<float>, val int")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "qid long, qv array<float>")
    assert [(r["qid"], r["key_id"], r["rank"]) for r in ann.exact_search(q, s, 5).orderBy("rank").collect()] == [(7, 0, 1), (7, 3, 2)]
    assert ann.exact_search(q.limit(0), s, 5).count() == 0
    assert ann.exact_search(q, s.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        ann.exact_search(q, s, 5, "cosine")


def test_ivf_with_all_cells_is_exact_and_recall_rises(spark):
    _, s = vectors(spark)
    q = s.where("key_id % 20 = 0").select(F.col("key_id").alias("qid"), F.col("key").alias("qv"))
    truth = ann.exact_search(q, s, 5)
    cells = ann.train_cells(s, 8)
    recall = [ann.recall_at_k(ann.ivf_search(q, s, cells, 5, p), truth).agg(F.avg("recall")).first()[0] for p in (1, 3, 8)]
    assert recall[0] <= recall[1] <= recall[2] == 1.0
    dot = lambda f: {(r["qid"], r["key_id"], r["rank"]) for r in f.collect()}
    assert dot(ann.ivf_search(q, s, cells, 5, 8, metric="dot")) == dot(ann.exact_search(q, s, 5, "dot"))
    assert ann.ivf_search(q.limit(0), s, cells, 5, 8).count() == 0 and ann.ivf_search(q, s.limit(0), cells, 5, 8).count() == 0


def test_stored_index_and_clusters(spark, tmp_path):
    _, s = vectors(spark)
    q = s.where("key_id % 20 = 0").select(F.col("key_id").alias("qid"), F.col("key").alias("qv"))
    cells = ann.train_cells(s, 8)
    tables.write_index(cells, ann.in_cells(s, cells), str(tmp_path / "index"))
    kept, inside = tables.read_index(spark, str(tmp_path / "index"))
    pick = lambda f: sorted((r["qid"], r["key_id"]) for r in f.collect())
    assert pick(ann.ivf_search(q, None, kept, 5, 3, inside)) == pick(ann.ivf_search(q, s, cells, 5, 3))
    tables.write_clusters(ann.assign_cells(s, cells).withColumnRenamed("cell_id", "cluster_id"), str(tmp_path / "clusters"))
    assert tables.read_clusters(spark, str(tmp_path / "clusters")).count() == s.count()
    assert tables.read_clusters(spark, str(tmp_path / "none")) is None and tables.read_clusters(spark, None) is None


def test_recall_of_the_index_query(spark):
    from lanternspark import queries as Q

    assert Q.ivf_recall_at_k(spark, "/root/testdata/sf0.01").agg(F.avg("recall")).first()[0] >= 0.9
    assert ann.recall_at_k(Q.pq_search(spark, "/root/testdata/sf0.01"), Q._nn(spark, "/root/testdata/sf0.01")).agg(F.avg("recall")).first()[0] >= 0.9


def test_product_codes_recall(spark):
    _, s = vectors(spark, 400)
    q = s.where("key_id % 20 = 0").select(F.col("key_id").alias("qid"), F.col("key").alias("qv"))
    cells = ann.train_cells(s, 4)
    book = ann.train_product_codes(s, cells, 4, codes=64)
    codes = ann.encode_product(s, cells, book)
    assert codes.count() == 400
    found = ann.top_k(ann.recomputed(ann.product_search(q, codes, cells, book, 40, 4), q, s).drop("rank"), 10)
    assert ann.recall_at_k(found, ann.exact_search(q, s, 10)).agg(F.avg("recall")).first()[0] >= 0.9


def test_distribution_sums_to_one_and_ends_of_interpolation(spark):
    _, s = vectors(spark)
    q = s.where("key_id % 40 = 0").select(F.col("key_id").alias("qid"), F.col("key").alias("qv"), F.col("val").alias("label"))
    k = knnlm.token_distribution(knnlm.neighbour_weights(knnlm.with_values(ann.exact_search(q, s, 9), s)))
    assert all(abs(r[0] - 1) < 1e-9 for r in k.groupBy("qid").agg(F.sum("prob")).select("sum(prob)").collect())
    lm = knnlm.unigram_lm(s)
    assert abs(lm.agg(F.sum(F.exp("logp"))).first()[0] - 1) < 0.05
    asked = q.select("qid", F.col("label").alias("token"))
    assert "CartesianProduct" not in (plan := knnlm.interpolated(k, lm, asked=asked)._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    assert {(r[0], r[1]) for r in asked.collect()} <= {(r[0], r[1]) for r in knnlm.interpolated(k, lm, asked=asked).collect()}
    at = lambda w: {(r[0], r[1]): r[2] for r in knnlm.interpolated(k, lm, w).collect()}
    ks, ms = {(r[0], r[1]): r[3] for r in k.collect()}, {r[0]: r[1] for r in lm.collect()}
    assert all(v == ms[x[1]] for x, v in at(0.0).items())
    assert all(at(1.0)[x] == ks[x] for x in ks)
    d = spark.createDataFrame([(-1.0, -2.0, 0.0, 0.0)], "a double, b double, z double, n double")
    r = d.select(F.exp(interpolate(F.col("a"), F.col("b"), 0.25)), safe_div(F.col("n"), F.col("z"))).first()
    assert abs(r[0] - (0.25 * np.exp(-1) + 0.75 * np.exp(-2))) < 1e-12 and r[1] == 1.0


def fold(keys, vals, queries, labels, k, min_knns, max_knns, clusters=None, no_pointer=False):
    """Step-by-step reference of the automaton for one sequence of 1-D keys."""
    n, cur, out = len(keys), [], []
    for q, y in zip(queries, labels):
        pointers = [c + 1 for c in cur]
        search = no_pointer or len(cur) < min_knns
        ext = [] if no_pointer else pointers[:max_knns]
        if ext and clusters is not None:
            count = {}
            for p in ext:
                count[clusters[p]] = count.get(clusters[p], 0) + 1
            for c in sorted(count, key=lambda c: (-count[c], c)):
                ext = ext + [i for i in range(n) if clusters[i] == c]
            ext = ext[:max_knns]
        bag = (sorted(range(n), key=lambda i: ((keys[i] - q) ** 2, i))[:k] if search else []) + ext
        d = np.array([(keys[i] - q) ** 2 for i in bag])
        p = np.exp(-d - (-d).max())
        p /= p.sum()
        dist = {}
        for i, x in zip(bag, p):
            dist[vals[i]] = dist.get(vals[i], 0) + x
        cur = [i for _, i in sorted((d[j], i) for j, i in enumerate(bag) if vals[i] == y and i < n - 1)]
        out.append((search, dist, cur))
    return out


KEYS, VALS, ASKED, GOLD = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0], [0, 1, 0, 1, 0, 1], [0.1, 1.2, 2.1, 0.4], [0, 1, 0, 0]
GOLDEN = [
    ({"min_knns": 1}, None, [(0.689974, [0]), (0.0, [1]), (1.0, [2]), (0.0, [])]),
    ({"min_knns": 1}, [0, 0, 1, 1, 2, 2], [(0.689974, [0]), (0.109765, [1, 1]), (0.869734, [2, 2, 2]), (0.956950, [2])]),
    ({"min_knns": 2}, None, [(0.689974, [0]), (0.215321, [1, 1]), (1.0, [2, 2]), (0.0, [])]),
    ({"min_knns": 1, "no_pointer": True}, None, [(0.689974, [0]), (0.354344, [1]), (0.689974, [2]), (0.549834, [0])]),
]


@pytest.mark.parametrize("kw,clusters,want", GOLDEN)
def test_automaton_golden(spark, kw, clusters, want):
    s = spark.createDataFrame([(i, [k], v) for i, (k, v) in enumerate(zip(KEYS, VALS))], "key_id long, key array<double>, val int")
    q = spark.createDataFrame([(3, t, [x], y) for t, (x, y) in enumerate(zip(ASKED, GOLD))], "seq_id long, t long, qv array<double>, label int")
    nn = ann.exact_search(q.select(F.col("t").alias("qid"), "qv"), s, 2).select(F.lit(3).cast("long").alias("seq_id"), F.col("qid").alias("t"), "key_id", "dist")
    cl = None if clusters is None else spark.createDataFrame(list(enumerate(clusters)), "key_id long, cluster_id long")
    steps, dist = automaton.decode(q, s, nn, 6, cl, max_knns=4, **kw)
    p0 = {r["t"]: r["prob"] for r in dist.where("token = 0").collect()}
    got = [(round(p0.get(r["t"], 0.0), 6), r["kept"]) for r in steps.orderBy("t").collect()]
    for (p, kept), (wp, wk), (_, d, c) in zip(got, want, fold(KEYS, VALS, ASKED, GOLD, 2, max_knns=4, clusters=clusters, **kw)):
        assert abs(p - wp) < 2e-6 and kept == wk
        assert abs(p - d.get(0, 0.0)) < 2e-6 and kept == c
    saved = automaton.lookups_saved(steps).first()
    assert saved["saved"] == 0 and saved["share"] == 0
    if kw == {"min_knns": 1} and clusters is None:
        assert automaton.lookups_saved(steps, count_trailing=True).first()["saved"] == 3
