"""CSV files of reports or dialogues to conversation JSON lines, file by file."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import SYSTEM_PROMPT, USER_PREFIX, USER_SUFFIX, strip
from ..operators import chat, ordinals
from .tables import listed, read_csv, write_conversations


@dataclass(frozen=True)
class Layout:
    """Which columns hold what; metadata maps names to columns.  Column names are compared without outer blanks."""

    context: str = "context"
    answer: str = "impression"
    metadata: dict[str, str] = field(default_factory=dict)
    system: str = SYSTEM_PROMPT
    prefix: str = USER_PREFIX
    suffix: str = USER_SUFFIX


REPORTS = Layout()
SECTIONED_DIALOGUES = Layout("dialogue", "section_text", {"id": "ID", "section_header": "section_header"})
CODED_DIALOGUES = Layout("Dialogue", "Note", {"icd10": "ICD10", "icd10_desc": "ICD10_desc"})


def conversations(df: DataFrame, layout: Layout = REPORTS, finetune: bool = False, shot: int = 42, alternate: int = 100) -> DataFrame:
    """messages (and metadata) of each row; `_row` gives the order of the rows.

    Null contents are empty texts, outer blanks go.  ValueError where there is no row.
    """
    text = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = df.select("_row", text(layout.context).alias("_c"), text(layout.answer).alias("_a"), *(F.col(c).alias(f"_m_{k}") for k, c in layout.metadata.items()))
    if rows.isEmpty():
        raise ValueError("no rows")
    if finetune:
        out = rows.withColumn("messages", chat.finetune_messages(F.col("_c"), F.col("_a"), layout.system))
        extra = []
    else:
        out = chat.one_shot(rows, "_row", "_c", "_a", shot, alternate, layout.system, layout.prefix, layout.suffix)
        extra = [F.col("example").cast("string").alias("one_shot_example_id")]
    if not layout.metadata:
        return out.select("messages")
    return out.select("messages", F.struct(*(F.col(f"_m_{k}").alias(k) for k in layout.metadata), *extra).alias("metadata"))


def convert_csv(spark: SparkSession, path: str, out: str, layout: Layout = REPORTS, finetune: bool = False, **kw) -> int:
    """Writes one file's conversations to a folder; returns their number."""
    df = read_csv(spark, path)
    df = df.toDF(*(c.strip() for c in df.columns))
    return write_conversations(conversations(df.withColumn("_row", F.monotonically_increasing_id()), layout, finetune, **kw), out)


def convert_folder(spark: SparkSession, folder: str, out: str, layout: Layout = REPORTS, finetune: bool = False, files: list[str] | None = None, **kw) -> DataFrame:
    """Converts every (or the named) CSV file; a file that fails doesn't stop the others.

    Returns file, output, rows, error; an empty table where there is no file.
    """
    done = []
    for name in files if files is not None else listed(spark, folder):
        if not name.endswith(".csv"):
            continue
        target = os.path.join(out, os.path.splitext(name)[0] + ("-finetune" if finetune else ""))
        try:
            done.append((name, target, convert_csv(spark, os.path.join(folder, name), target, layout, finetune, **kw), None))
        except Exception as e:
            done.append((name, target, None, str(e).splitlines()[0]))
    return spark.createDataFrame(done, "file string, output string, rows long, error string")
