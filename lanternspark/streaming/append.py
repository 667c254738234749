"""Datastore append from a stream of (key, val) rows: each micro-batch is numbered on from the last.

Exactly once: a batch's files go to a folder of its number, which a repeated batch overwrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordinals import ordinal


def append_stream(stream: DataFrame, path: str, checkpoint: str, order: str, cap: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Writes batches to path/batch_id=N with key_id running on over batches; rows from `cap` on are cut off."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        start = 0
        try:
            last = spark.read.parquet(path).where(F.col("batch_id") < number).agg(F.max("key_id")).first()[0]
            start = 0 if last is None else last + 1
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        rows = ordinal(batch, order, name="key_id").withColumn("key_id", F.col("key_id") + start)
        if cap is not None:
            rows = rows.where(F.col("key_id") < cap)
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
