"""Documents into blocks of fixed capacity: first-fit decreasing in randomised groups (problem 6).

Sizes are tokens of a public tokenizer.  Documents are dealt to groups by a seeded hash;
each group is packed on its own, largest first, into the first block with room.  The
first block is found in a tournament tree over the blocks' room, so a group of n pieces
takes n log n steps.  Groups have about `group_docs` documents however many there are, and
each wastes at most the tail of its own blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.session import cut_lineage

MOST_CONFIGS = 100
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the published word pattern of the byte-level vocabulary
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path: str = TOKENIZER):
    """Tokenizer of a rank file; read once a process."""
    import base64

    import tiktoken

    kept = vars(tiktoken).setdefault("_kept_encodings", {})
    if path not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[path]


def token_sizes(df: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """id, tokens of each row; null texts have 0."""

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for t in batches:
            n = [len(encode(x)) if x else 0 for x in t.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column("id"), pa.array(n, pa.int64())], names=["id", "tokens"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(size, "id long, tokens long")


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """Block of each size, in the given order: the first block with room.  Sizes are 1 to capacity."""
    width = 1
    while width < len(sizes):
        width *= 2
    room = [capacity] * (2 * width)  # room[1] is the most that any block has left
    out = []
    for s in sizes:
        i = 1
        while i < width:
            i *= 2
            if room[i] < s:
                i += 1
        out.append(i - width)
        room[i] -= s
        while i > 1:
            i //= 2
            a, b = room[2 * i], room[2 * i + 1]
            m = a if a >= b else b
            if room[i] == m:
                break
            room[i] = m
    return out


def pack(sizes: DataFrame, capacities: DataFrame, group_docs: int = 16_000, seed: int = 17) -> DataFrame:
    """config_name, block_size, block, id, piece, start, tokens.

    sizes: id, tokens; capacities: config_name, block_size (a small fixed table).  A row larger
    than a block fills whole blocks and its rest is packed like any other; nothing else is
    split.  block is unique within a config.  Rows without tokens take no room and are left
    out, as are capacities that are null or below 1; equal sizes are taken in order of id.
    """
    sizes = sizes.where("tokens > 0")
    groups = max(1, -(-sizes.count() // group_docs))
    configs = capacities.where("block_size >= 1").select("config_name", F.col("block_size").cast("long").alias("block_size")).distinct().limit(MOST_CONFIGS + 1).collect()
    if len(configs) > MOST_CONFIGS:
        raise ValueError(f"more than {MOST_CONFIGS} capacities")
    each = F.array(*(F.struct(F.lit(c[0]).cast("string").alias("config_name"), F.lit(c[1]).cast("long").alias("block_size")) for c in configs)).cast(
        "array<struct<config_name:string,block_size:long>>"
    )
    rows = sizes.withColumn("c", F.explode(each)).select(
        "c.config_name", "c.block_size", "id", "tokens", F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(groups)).alias("group")
    )

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cap, group = int(pdf["block_size"].iat[0]), int(pdf["group"].iat[0])
        pdf = pdf.sort_values(["id"], kind="stable")
        ids, n = pdf["id"].to_numpy(), pdf["tokens"].to_numpy()
        whole, rest = n // cap, n % cap
        full_of = np.repeat(np.arange(len(n)), whole)
        piece = np.arange(len(full_of)) - np.repeat(np.cumsum(whole) - whole, whole)
        order = np.flatnonzero(rest)
        order = order[np.argsort(-rest[order], kind="stable")]
        block = np.array(first_fit(rest[order].tolist(), cap), dtype=np.int64) + len(full_of)
        return pd.DataFrame(
            {
                "config_name": pdf["config_name"].iat[0],
                "block_size": cap,
                "block": (group << 40) + np.concatenate((np.arange(len(full_of)), block)),
                "id": np.concatenate((ids[full_of], ids[order])),
                "piece": np.concatenate((piece, whole[order])),
                "start": np.concatenate((piece * cap, whole[order] * cap)),
                "tokens": np.concatenate((np.full(len(full_of), cap), rest[order])),
            }
        )

    return rows.groupBy("config_name", "block_size", "group").applyInPandas(
        one, "config_name string, block_size long, block long, id long, piece long, start long, tokens long"
    )


def pack_documents(documents: DataFrame, capacities: DataFrame, path: str = TOKENIZER, **kw) -> DataFrame:
    """Sizes the texts of documents (doc_id, text) and packs them; see pack."""
    return pack(cut_lineage(token_sizes(documents, path=path)), capacities, **kw).withColumnRenamed("id", "doc_id")


def fill_rates(packed: DataFrame) -> DataFrame:
    """config_name, block_size, blocks, tokens, least_blocks (no packing has fewer), fill."""
    return packed.groupBy("config_name", "block_size").agg(
        F.countDistinct("block").alias("blocks"),
        F.sum("tokens").alias("tokens"),
        F.ceil(F.sum("tokens") / F.col("block_size")).alias("least_blocks"),
        F.round(F.sum("tokens") / (F.countDistinct("block") * F.col("block_size")), 6).alias("fill"),
    )
