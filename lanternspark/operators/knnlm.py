"""Next-token distributions from neighbours, and their interpolation with a language model.

Distributions are sparse: a token that no neighbour names has log-probability FLOOR.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.probability import FLOOR, floor_log, interpolate, softmax
from .ann import nearness


def with_values(hits: DataFrame, store: DataFrame) -> DataFrame:
    """Neighbours with the token that follows each key; the value column alone is read."""
    return hits.join(store.select("key_id", "val"), "key_id")


def neighbour_weights(hits: DataFrame, temperature: float = 1.0, metric: str = "l2", by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Adds prob, the softmax of nearness / temperature among each query's neighbours."""
    return hits.withColumn("prob", softmax(nearness(F.col("dist"), metric) / F.lit(float(temperature)), *by))


def token_distribution(weighted: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """by, token, prob, logp: the neighbours' mass by token; a neighbour that stands twice counts twice."""
    return weighted.groupBy(*by, F.col("val").alias("token")).agg(F.sum("prob").alias("prob")).withColumn("logp", floor_log(F.col("prob")))


def interpolated(knn: DataFrame, lm: DataFrame, weight: float | None = 0.25, by: tuple[str, ...] = ("qid",), asked: DataFrame | None = None) -> DataFrame:
    """by, token, logp for the tokens that neighbours name and those asked for (by, token).

    knn: by, token, logp; lm: token, logp, or by, token, logp.  Any other token has log(1 - weight) + its
    logp in lm, which needs no row for each query: queries are never crossed with the vocabulary.  A token that one
    side doesn't know has FLOOR there.  Without a weight both parts are given as k and m.
    """
    k = knn.select(*by, "token", F.col("logp").alias("k"))
    if asked is not None:
        k = k.join(asked.where("token is not null").select(*by, "token").distinct(), [*by, "token"], "full")
    on = [c for c in (*by, "token") if c in lm.columns]
    j = k.join(lm.select(*on, F.col("logp").alias("m")), on, "left").na.fill(FLOOR, ["k", "m"])
    if weight is None:
        return j.select(*by, "token", "k", "m")
    return j.select(*by, "token", interpolate(F.col("k"), F.col("m"), weight).alias("logp"))


def unigram_lm(store: DataFrame) -> DataFrame:
    """token, logp: add-one unigram distribution of the datastore's values."""
    counts = store.where("val is not null").groupBy(F.col("val").alias("token")).agg(F.count("*").alias("_n"))
    total, kinds = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
    return counts.select("token", F.log((F.col("_n") + 1) / F.lit(float(total + kinds))).alias("logp"))


def mean_loss(dist: DataFrame, queries: DataFrame, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """loss, ppl: mean of minus log p of the queries' labels (FLOOR where absent), and its exponential."""
    gold = queries.where("label is not null").select(*by, F.col("label").alias("token"))
    x = gold.join(dist, [*by, "token"], "left").select(F.coalesce("logp", F.lit(FLOOR)).alias("logp"))
    return x.agg((-F.avg("logp")).alias("loss")).withColumn("ppl", F.exp("loss"))


def last_positions(queries: DataFrame, seq: str = "seq_id", t: str = "t") -> DataFrame:
    """Only the newest position of each sequence."""
    last = queries.groupBy(seq).agg(F.max(t).alias(t))
    return queries.join(last, [seq, t], "left_semi")
