"""Automaton-guided retrieval: neighbours' successors replace searches while enough of them fit.

The state of a sequence is its list of keys that explained the last token.  All sequences
advance together, one time step at a go, by joins on key_id; nothing of the datastore is
broadcast, and lineage is cut after each step.  A search is only used where a sequence has
fewer than min_knns pointers; the neighbours of those (sequence, step) pairs are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.probability import softmax
from ..plans.session import cut_lineage
from .ann import distance, nearness


def successors(keys: DataFrame, store: DataFrame) -> DataFrame:
    """Adds next_id and next_val, the datastore's following entry (null at the end)."""
    nxt = store.select(F.col("key_id").alias("next_id"), F.col("val").alias("next_val"))
    return keys.withColumn("next_id", F.col("key_id") + 1).join(nxt, "next_id", "left")


def valid_pointers(hits: DataFrame, size: int) -> DataFrame:
    """Neighbours whose value is the label and that have a successor."""
    return hits.where((F.col("val") == F.col("label")) & (F.col("key_id") < size - 1))


def cluster_heads(clusters: DataFrame, most: int) -> DataFrame:
    """cluster_id, members: the first `most` keys of each cluster; no expansion can take more."""
    w = Window.partitionBy("cluster_id").orderBy("key_id")
    return (
        clusters.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
        .groupBy("cluster_id").agg(F.array_sort(F.collect_list("key_id")).alias("members"))
    )


def expand_clusters(state: DataFrame, clusters: DataFrame, most: int, id_col: str = "seq_id") -> DataFrame:
    """id, ext: pointers, then all members of their clusters, most frequent cluster first (ties by id), cut to `most`.

    state: id, pointers (array<long>).
    """
    p = state.select(id_col, F.explode("pointers").alias("key_id")).join(clusters, "key_id").groupBy(id_col, "cluster_id").agg(F.count("*").alias("_n"))
    m = p.join(cluster_heads(clusters, most), "cluster_id").groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), "cluster_id", "members"))).alias("_m")
    )
    return state.join(m, id_col, "left").select(
        id_col,
        F.slice(F.concat("pointers", F.coalesce(F.flatten(F.transform("_m", lambda x: x["members"])), F.array().cast("array<long>"))), 1, most).alias("ext"),
    )


def decode(
    queries: DataFrame,
    store: DataFrame,
    neighbours: DataFrame,
    size: int,
    clusters: DataFrame | None = None,
    min_knns: int = 1,
    max_knns: int = 1024,
    no_pointer: bool = False,
    temperature: float = 1.0,
    metric: str = "l2",
) -> tuple[DataFrame, DataFrame]:
    """(steps, distribution) of teacher-forced decoding.

    queries: seq_id, t (0, 1, ... in each sequence), qv, label; neighbours: seq_id, t, key_id, dist; size: entries
    of the datastore.  steps: seq_id, t, searched, candidates, kept, saved (steps since the last search).
    distribution: seq_id, t, token, prob.
    """
    spark = queries.sparkSession
    last = queries.agg(F.max("t")).first()[0]
    state = queries.select("seq_id").distinct().select("seq_id", F.array().cast("array<long>").alias("cur"), F.lit(0).cast("long").alias("counter"))
    values = store.select("key_id", "val")
    steps = dists = None
    for t in range(-1 if last is None else last + 1):
        now = queries.where(F.col("t") == t).select("seq_id", "qv", "label").join(state, "seq_id")
        now = now.withColumn("pointers", F.transform("cur", lambda x: x + 1)).withColumn("searched", F.lit(no_pointer) | (F.size("cur") < min_knns))
        if no_pointer:
            ext = now.select("seq_id", F.array().cast("array<long>").alias("ext"))
        elif clusters is None:
            ext = now.select("seq_id", F.slice("pointers", 1, max_knns).alias("ext"))
        else:
            ext = expand_clusters(now.select("seq_id", F.slice("pointers", 1, max_knns).alias("pointers")), clusters, max_knns)
        own = (
            now.select("seq_id", "qv").join(ext, "seq_id").select("seq_id", "qv", F.posexplode("ext").alias("_i", "key_id"))
            .join(store.select("key_id", "key", "val"), "key_id")
            .select("seq_id", "key_id", "val", distance(F.col("qv"), F.col("key"), metric).alias("dist"), F.col("_i"))
        )
        found = (
            neighbours.where(F.col("t") == t).join(now.where("searched").select("seq_id"), "seq_id", "left_semi").join(values, "key_id")
            .select("seq_id", "key_id", "val", "dist", F.lit(-1).alias("_i"))
        )
        bag = found.unionByName(own)  # a key that is found and pointed to stands twice
        bag = cut_lineage(bag.withColumn("prob", softmax(nearness(F.col("dist"), metric) / F.lit(float(temperature)), "seq_id")))
        dist = bag.groupBy("seq_id", F.lit(t).cast("long").alias("t"), F.col("val").alias("token")).agg(F.sum("prob").alias("prob"))
        kept = (
            bag.join(now.select("seq_id", "label"), "seq_id").where((F.col("val") == F.col("label")) & (F.col("key_id") < size - 1))
            .groupBy("seq_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-nearness(F.col("dist"), metric)).alias("d"), "key_id", "_i"))), lambda x: x["key_id"]).alias("kept"))
        )
        count = bag.groupBy("seq_id").agg(F.count("*").alias("candidates"))
        step = (
            now.select("seq_id", "searched", "counter").join(count, "seq_id", "left").join(kept, "seq_id", "left")
            .select(
                "seq_id", F.lit(t).cast("long").alias("t"), "searched", F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"),
                F.coalesce("kept", F.array().cast("array<long>")).alias("kept"), F.when(F.col("searched"), F.col("counter")).alias("saved"),
                F.when(F.col("searched"), 0).otherwise(F.col("counter") + 1).cast("long").alias("counter"),
            )
        )
        step = cut_lineage(step)
        state = step.select("seq_id", F.col("kept").alias("cur"), "counter")
        steps = step if steps is None else steps.unionByName(step)
        dists = dist if dists is None else dists.unionByName(dist)
    if steps is None:
        steps = spark.createDataFrame([], "seq_id long, t long, searched boolean, candidates long, kept array<long>, saved long, counter long")
        dists = spark.createDataFrame([], "seq_id long, t long, token long, prob double")
    return steps, dists


def lookups_saved(steps: DataFrame, count_trailing: bool = False) -> DataFrame:
    """searches, saved, share: saved steps are noted at the next search; a trailing run counts only with count_trailing.

    No searches and none saved give a null share.
    """
    s = steps.agg(F.count("saved").alias("searches"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"))
    if count_trailing:
        w = Window.partitionBy("seq_id").orderBy(F.col("t").desc())
        rest = steps.withColumn("_r", F.row_number().over(w)).where("_r = 1").agg(F.coalesce(F.sum("counter"), F.lit(0)).alias("_c"))
        s = s.join(rest).select("searches", (F.col("saved") + F.col("_c")).alias("saved"))  # one row each
    return s.withColumn("share", F.try_divide(F.col("saved"), F.col("saved") + F.col("searches")))
