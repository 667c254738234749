"""Global row numbers, exact-size splits and nested samples, without a single-task sort.

Pseudo-random order is that of md5(seed:id), the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.session import cut_lineage


def ordinal(df: DataFrame, *by: Column | str, name: str = "ordinal") -> DataFrame:
    """Adds a dense row number from 0 in the order of `by` (which should be unique).

    Rows are range-partitioned, sorted and written once; a count for each partition gives the offsets, which are sent to
    the tasks (a number for each partition).
    """
    rows = cut_lineage(
        df.repartitionByRange(*(F.col(c) if isinstance(c, str) else c for c in by)).sortWithinPartitions(*by).withColumn("__mid", F.monotonically_increasing_id())
    )
    part, row = F.shiftright("__mid", 33), F.col("__mid").bitwiseAND((1 << 33) - 1)
    sizes = rows.groupBy(part.alias("__part")).count()  # a row for each partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    return rows.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__base") + row).drop("__mid", "__part", "__base")


def shuffle_key(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def shuffled(df: DataFrame, id_col: str, seed: int = 42, name: str = "rank") -> DataFrame:
    """Adds the row's place (from 0) in the seeded pseudo-random order; equal ids stand next to each other."""
    return ordinal(df.withColumn("__key", shuffle_key(id_col, seed)), "__key", id_col, name=name).drop("__key")


def split_three(df: DataFrame, id_col: str, held_out: float = 0.2, test_share: float = 0.5, seed: int = 42) -> DataFrame:
    """Adds split: train, val, test of exact sizes (held_out and its test share are rounded up)."""
    n = df.count()
    held = -int(-n * held_out // 1)
    test = -int(-held * test_share // 1)
    r = shuffled(df, id_col, seed, "__rank")
    return r.withColumn("split", F.when(F.col("__rank") < test, "test").when(F.col("__rank") < held, "val").otherwise("train")).drop("__rank")


PERCENTS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 30)


def nested_samples(df: DataFrame, id_col: str, percents: tuple[int, ...] = PERCENTS, by: str | None = None, seed: int = 42) -> DataFrame:
    """One row for each sample a row is in: adds percent.  A sample of p % has round-half-even(n p / 100) rows of
    each group `by`, and smaller samples are prefixes of larger ones."""
    keys = [by] if by else []
    r = ordinal(df.withColumn("__key", shuffle_key(id_col, seed)), *keys, "__key", id_col, name="__rank").drop("__key")
    if by:
        size = r.groupBy(by).agg(F.count("*").alias("__n"), F.min("__rank").alias("__first"))
        r = r.join(size, by)
    else:
        n = r.agg(F.count("*")).first()[0]
        r = r.withColumn("__n", F.lit(n)).withColumn("__first", F.lit(0).cast("long"))
    r = r.withColumn("percent", F.explode(F.array(*(F.lit(p) for p in percents))))
    return r.where(F.col("__rank") - F.col("__first") < F.bround(F.col("__n") * F.col("percent") / 100)).drop("__rank", "__n", "__first")


def head_tail(df: DataFrame, *by: Column | str, percent: int = 5) -> DataFrame:
    """Adds split: the first `percent` % of the rows in order of `by` are validation, the rest train."""
    r = ordinal(df, *by, name="__at")
    cut = df.count() * percent // 100
    return r.withColumn("split", F.when(F.col("__at") < cut, "validation").otherwise("train")).drop("__at")


def offset_limit(df: DataFrame, *by: Column | str, offset: int, limit: int, name: str = "idx") -> DataFrame:
    """Rows offset to offset+limit-1 in order of `by`, with their row number."""
    return ordinal(df, *by, name=name).where((F.col(name) >= offset) & (F.col(name) < offset + limit))


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row for each key: of rows delivered several times the earliest; null keys are left out, ties take any equal row."""
    cols = [c for c in df.columns if c not in (key, at)]
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(at, *cols), F.struct(F.col(at).isNull(), F.col(at))).alias("_r"))
        .select(key, "_r.*")
    )


def bounded_sample(df: DataFrame, id_col: str, most: int, seed: int = 1) -> DataFrame:
    """At most `most` rows, those of least seeded hash of the id.

    Rows are thinned to about twice as many by a share of the hash first, so that a task of
    a large table sends a few rows and not `most` of them.
    """
    h = F.xxhash64(F.col(id_col), F.lit(seed))
    n = df.count()
    if n > 4 * most:
        df = df.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 2 * most / n))
    return df.orderBy(F.pmod(h, F.lit(1 << 40)), id_col).limit(most)
