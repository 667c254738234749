"""Conversation records and word classes shared by the operators on record pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .words import normal_text

SPLITS = {s: f"mimic_inspired_{s}_context_impression_finetune" for s in ("train", "val", "test")}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def said(role: str) -> Column:
    """Content of the first message of a role; no such message or null content is the empty text."""
    m = F.filter("messages", lambda x: x["role"] == role)
    return F.coalesce(F.get(m, F.lit(0))["content"], F.lit(""))


def record_words(df: DataFrame) -> DataFrame:
    """record_id, cls, words: user and assistant content as normal words.

    Records of equal words have equal cls (64-bit hash of the words); replayed rows of a
    record stay, they fall together later by (record_id, cls).  Rows without id are left out.
    """
    words = normal_text(F.concat(said("user"), F.lit(" "), said("assistant")))
    return (
        df.where("record_id is not null")
        .select("record_id", words.alias("words"))
        .withColumn("cls", F.xxhash64("words"))
    )


def expand(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of classes (cls_a, cls_b) to pairs of record ids, smaller id first."""
    x = (
        pairs.join(a.select(F.col("cls").alias("cls_a"), F.col("record_id").alias("_x")), "cls_a")
        .join(b.select(F.col("cls").alias("cls_b"), F.col("record_id").alias("_y")), "cls_b")
        .where("_x <> _y")
    )
    return x.select(F.least("_x", "_y").alias("record_id_a"), F.greatest("_x", "_y").alias("record_id_b"))
