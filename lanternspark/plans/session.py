"""Session helpers: defaults for local runs, and where lineage may be cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "lanternspark", **extra: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in (LOCAL_DEFAULTS | extra).items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only where that setting is absent (tests, local mode) a folder of our own is used.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "lanternspark-checkpoints")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where


_written: list[tuple[SparkSession, str]] = []


def work_path(spark: SparkSession, kind: str) -> str:
    """A new folder under the shared one, which is removed when the process ends."""
    if not _written:
        atexit.register(remove_work)
    path = f"{checkpoint_dir(spark).rstrip('/')}/lanternspark-{kind}/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def remove_work() -> None:
    """Deletes the folders that this process wrote; DataFrames on them can't be read after that."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the context has been stopped
            if "://" not in path:
                shutil.rmtree(path, ignore_errors=True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise as a table in the shared checkpoint folder, so that lost executors cost nothing already done.

    A written table is computed once, where an eager checkpoint() computes its last stage twice.
    """
    path = work_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
