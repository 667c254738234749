"""Exact similarity of candidate pairs of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import WordIds, sequences


MARKS = 1 << 20


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds words_a and words_b to (cls_a, cls_b, ...); texts (cls, words) may repeat a class.

    Only texts that stand in a pair are gathered, once.  Marks of the needed classes, at most MARKS whatever
    their number, leave out most other texts before the shuffle.
    """
    need = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    mark = F.pmod(F.xxhash64("cls"), F.lit(MARKS))
    marks = need.select(mark.alias("_mark")).distinct()
    some = texts.withColumn("_mark", mark).join(F.broadcast(marks), "_mark", "left_semi").drop("_mark")
    one = some.join(need, "cls", "left_semi").groupBy("cls").agg(F.first("words").alias("words"))
    return pairs.join(one.select(F.col("cls").alias("cls_a"), F.col("words").alias("words_a")), "cls_a").join(
        one.select(F.col("cls").alias("cls_b"), F.col("words").alias("words_b")), "cls_b"
    )


def jaccard(pairs: DataFrame, k: int, least: float) -> DataFrame:
    """cls_a, cls_b, similarity of those pairs (with words_a, words_b) that reach `least`.

    Similarity: distinct k-word sequences in both, divided by those in either; texts
    without any are similar to nothing.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordIds()
        for t in batches:
            a, b = t.column("words_a").to_pylist(), t.column("words_b").to_pylist()
            s = np.zeros(len(a))
            for i, (x, y) in enumerate(zip(a, b)):
                p, q = np.unique(sequences(memo.of(x), k)), np.unique(sequences(memo.of(y), k))
                if len(p) and len(q):
                    n = len(p) + len(q) - len(np.union1d(p, q))
                    s[i] = n / (len(p) + len(q) - n)
            keep = pa.array(s >= least)
            yield pa.RecordBatch.from_arrays(
                [t.column("cls_a").filter(keep), t.column("cls_b").filter(keep), pa.array(s).filter(keep)],
                names=["cls_a", "cls_b", "similarity"],
            )

    return pairs.select("cls_a", "cls_b", "words_a", "words_b").mapInArrow(check, "cls_a long, cls_b long, similarity double")
