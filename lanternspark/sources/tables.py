"""Readers and writers: report CSVs, conversation JSON lines, vectors, split tables.

Writers of datastores refuse to overwrite; others overwrite.  Where files are several, the
source's stem is kept as a column.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.text import file_stem

CONVERSATION = T.StructType(
    [
        T.StructField("messages", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "txt": "text", "parquet": "parquet"}


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Quoted multi-line CSV with a header; without a schema all columns are strings by header.  Adds nothing."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
    return (r.schema(schema) if schema else r.option("inferSchema", False)).csv(paths)


def read_many(spark: SparkSession, folder: str, files: list[str] | None = None, ext: str = ".csv") -> DataFrame:
    """All (or the named) CSV files of a folder, with their stem as `source_stem`; FileNotFoundError where there is none."""
    names = files if files is not None else listed(spark, folder)
    paths = [os.path.join(folder, f) for f in names if f.endswith(ext)]
    if not paths:
        raise FileNotFoundError(f"no {ext} file in {folder}")
    return read_csv(spark, paths).withColumn("source_stem", file_stem(F.input_file_name()))


def read_conversations(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON lines of conversations."""
    return spark.read.schema(CONVERSATION).json(path)


def read_splits(spark: SparkSession, files: dict[str, str], schema: T.StructType | None = None, line_sep: str | None = None, extension: str | None = None) -> DataFrame:
    """One table of several splits' files with a split column; the format is that of the extension (csv, json, jsonl, txt, parquet), or the one given."""
    out = None
    for split, path in files.items():
        ext = extension or path.rsplit(".", 1)[-1]
        if ext not in FORMATS:
            raise ValueError(f"extension {ext!r} is none of {sorted(FORMATS)}")
        if ext == "csv":
            df = read_csv(spark, path, schema)
        else:
            r = spark.read.format(FORMATS[ext])
            r = r.schema(schema) if schema and ext != "txt" else r
            df = (r.option("lineSep", line_sep) if line_sep else r).load(path)
        df = df.withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def read_datastore(spark: SparkSession, path: str, keys: bool = True) -> DataFrame:
    """A datastore; without keys only key_id and val are read."""
    df = spark.read.parquet(path)
    return df if keys else df.select("key_id", "val")


def existing(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """The paths that exist; FileNotFoundError where none does."""
    found = {k: p for k, p in paths.items() if exists(spark, p)}
    if not found:
        raise FileNotFoundError(f"none of {sorted(paths.values())} exists")
    return found


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_conversations(df: DataFrame, path: str) -> int:
    """JSON lines of messages (and metadata); returns the number written, counted on the way."""
    from pyspark.sql import Observation

    seen = Observation()
    cols = [c for c in ("messages", "metadata") if c in df.columns]
    df.select(*cols).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def write_datastore(df: DataFrame, path: str, cap: int | None = None) -> None:
    """key_id, key, val, ...; rows from `cap` on are cut off.  An existing datastore is an error: delete it first."""
    (df if cap is None else df.where(F.col("key_id") < cap)).write.mode("errorifexists").parquet(path)


def write_index(cells: DataFrame, vectors: DataFrame, path: str) -> None:
    """Centroids, and vectors or codes (with cell_id) partitioned by cell, so that probes read only their cells."""
    cells.write.mode("overwrite").parquet(f"{path}/centroids")
    vectors.repartition("cell_id", F.pmod(F.xxhash64("key_id"), F.lit(16))).write.mode("overwrite").partitionBy("cell_id").parquet(f"{path}/vectors")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Centroids and vectors of a written index."""
    vectors = spark.read.parquet(f"{path}/vectors")
    return spark.read.parquet(f"{path}/centroids"), vectors.withColumn("cell_id", F.col("cell_id").cast("long"))


def write_clusters(members: DataFrame, path: str) -> None:
    """key_id, cluster_id."""
    members.select("key_id", "cluster_id").write.mode("overwrite").parquet(path)


def read_clusters(spark: SparkSession, path: str | None) -> DataFrame | None:
    """A written cluster table; None, which turns clusters off, where there is no path or nothing at it."""
    return spark.read.parquet(path) if path and exists(spark, path) else None


def exists(spark: SparkSession, path: str) -> bool:
    """Is there anything at a path of any file system that Spark knows?"""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(f.getPath().getName() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p))


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)
