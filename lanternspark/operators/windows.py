"""Sliding token windows and the key/value datastore built from them.

Token positions run through the documents of a batch (`batch_rows` documents).  Window w
of a batch of `total` tokens (cut to whole blocks if there is at least one) covers
[max((w+1) stride - block, 0), min((w+1) stride, total)) and scores the last
min((w+1) stride, total) - w stride of them.  The closed form needs no loop and no giant arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import tokens
from .ordinals import ordinal


def token_rows(df: DataFrame, order: str, text: str = "text", batch_rows: int = 1000) -> DataFrame:
    """batch, pos, token, order: every token with its position in its batch; documents in the given order."""
    rows = ordinal(df.where(F.col(order).isNotNull()), order, name="_ord").select(order, "_ord", tokens(F.col(text)).alias("_t"))
    rows = rows.withColumn("batch", F.expr(f"_ord div {batch_rows}")).withColumn("_n", F.size("_t"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("batch").orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).select(
        "batch", order, F.posexplode("_t").alias("_p", "token"), "_before"
    ).select("batch", (F.col("_before") + F.col("_p")).alias("pos"), "token", order)


def batch_totals(df: DataFrame, order: str, text: str = "text", batch_rows: int = 1000) -> DataFrame:
    """batch, tokens."""
    rows = ordinal(df.where(F.col(order).isNotNull()), order, name="_ord").select("_ord", F.size(tokens(F.col(text))).alias("_n"))
    return rows.groupBy(F.expr(f"_ord div {batch_rows}").alias("batch")).agg(F.sum("_n").cast("long").alias("tokens"))


def windows(totals: DataFrame, block: int, stride: int) -> DataFrame:
    """batch, window, begin, stop, scored, padding of every window; totals: batch, tokens."""
    t = totals.where("tokens > 0").withColumn(
        "_total", F.when(F.col("tokens") >= block, F.expr(f"tokens div {block} * {block}")).otherwise(F.col("tokens"))
    )
    w = t.withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_total - 1) div {stride}"))))
    stop = F.least((F.col("window") + 1) * stride, F.col("_total"))
    begin = F.greatest((F.col("window") + 1) * stride - block, F.lit(0))
    return w.select(
        "batch", "window", begin.alias("begin"), stop.alias("stop"), (stop - F.col("window") * stride).alias("scored"), (block - (stop - begin)).alias("padding")
    )


def window_blocks(token_table: DataFrame, wins: DataFrame, pad: str = "<pad>") -> DataFrame:
    """batch, window, input_ids, labels (null where not scored), attention_mask: the blocks themselves.

    attention_mask is 1 throughout, padding included.  Each token joins the windows that cover it.
    """
    w = wins.select(F.col("batch").alias("_b"), "window", "begin", "stop", "scored", "padding")
    j = token_table.join(w, F.expr("batch = _b and pos >= begin and pos < stop"))
    g = j.groupBy("batch", "window", "padding", "scored", "begin", "stop").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("_r"))
    ids = F.transform("_r", lambda r: r["token"])
    return g.select(
        "batch",
        "window",
        F.concat(ids, F.array_repeat(F.lit(pad), F.col("padding").cast("int"))).alias("input_ids"),
        F.concat(
            F.transform("_r", lambda r: F.when(r["pos"] >= F.col("stop") - F.col("scored"), r["token"])),
            F.array_repeat(F.lit(None).cast("string"), F.col("padding").cast("int")),
        ).alias("labels"),
        F.array_repeat(F.lit(1), (F.col("stop") - F.col("begin") + F.col("padding")).cast("int")).alias("attention_mask"),
    )


def emitted(token_table: DataFrame, totals: DataFrame, block: int, stride: int) -> DataFrame:
    """batch, window, pos, token: the (key at pos - 1, value token) pairs that windows score.

    Position p of window w = p div stride is scored unless it is the window's first token.
    """
    cut = totals.withColumn("_total", F.when(F.col("tokens") >= block, F.expr(f"tokens div {block} * {block}")).otherwise(F.col("tokens"))).select("batch", "_total")
    return (
        token_table.join(cut, "batch")
        .where("pos < _total")
        .withColumn("window", F.expr(f"pos div {stride}"))
        .where(f"pos > greatest((window + 1) * {stride} - {block}, 0)")
        .drop("_total")
    )


def datastore(pairs: DataFrame, cap: int | None = None) -> DataFrame:
    """key_id, batch, window, pos, val: pairs numbered from 0 in order of batch and position; beyond `cap` they are cut off."""
    out = ordinal(pairs.withColumnRenamed("token", "val"), "batch", "pos", name="key_id")
    return out if cap is None else out.where(F.col("key_id") < cap)
