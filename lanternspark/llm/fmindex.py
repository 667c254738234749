"""Leaked evaluation passages by an FM-index over words for each shard of the corpus (problem 7).

A shard is a bounded number of words of whole documents; it is indexed once, and every block of items is searched in it.  Words outside of the items'
vocabulary can't match; a run of them becomes one symbol 0, and every 0 counts as
different from all others, which ends comparisons early.  Over the shard's suffix order stand
the Burrows-Wheeler transform in a wavelet matrix and sampled suffix positions.  The
items' four-word sequences are searched backwards, all at once, occurrences are located by
walking to sampled positions, and matches are merged into spans for removal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import normal_text

SHARD_WORDS = 1_000_000
ITEMS_AT_ONCE = 2_000  # a shard is searched for so many items at a time
SAMPLE = 8


def suffix_array(code: np.ndarray) -> np.ndarray:
    """Suffix order of a text of symbols >= 0 that ends with 0; each 0 is less than those after it and all others."""
    n, zero = len(code), code == 0
    nz = int(zero.sum())
    below = np.cumsum(np.bincount(code, minlength=2))
    rank = np.where(zero, np.cumsum(zero) - 1, below[np.maximum(code, 1) - 1]).astype(np.int64)
    act, h = np.flatnonzero(~zero), 1
    while len(act):
        key = rank[act] * n + rank[act + h]
        order = np.argsort(key, kind="stable")
        act, key = act[order], key[order]
        old = rank[act]
        at = np.arange(len(act))
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        new_old = np.concatenate(([True], old[1:] != old[:-1]))
        first_key = np.maximum.accumulate(np.where(new_key, at, 0))
        first_old = np.maximum.accumulate(np.where(new_old, at, 0))
        rank[act] = old + first_key - first_old
        alone = new_key & np.concatenate((new_key[1:], [True]))
        act, h = act[~alone], 2 * h
    sa = np.empty(n, dtype=np.int64)
    sa[rank] = np.arange(n)
    return sa


class WaveletMatrix:
    """Rank of a symbol among the first i of a sequence, for many (symbol, i) at once."""

    def __init__(self, v: np.ndarray, bits: int):
        self.levels = []
        symbols = np.arange(1 << bits)
        start = np.zeros(1 << bits, dtype=np.int64)
        for b in range(bits - 1, -1, -1):
            one = ((v >> b) & 1).astype(bool)
            ones = np.zeros(len(v) + 1, dtype=np.int32)
            np.cumsum(one, out=ones[1:])
            z = len(v) - int(ones[-1])
            self.levels.append((b, ones, z))
            s1 = ones[start]
            start = np.where((symbols >> b) & 1, z + s1, start - s1)
            v = np.concatenate((v[~one], v[one]))
        self.start = start

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, ones, z in self.levels:
            one = ones[i]
            i = np.where((c >> b) & 1, z + one, i - one)
        return i - self.start[c]


class FMIndex:
    """Index of a text of symbols 0 <= s < size that ends with 0; patterns don't hold 0."""

    def __init__(self, code: np.ndarray, size: int, sample: int = SAMPLE):
        sa = suffix_array(code)
        self.bwt = code[sa - 1]
        self.bwt[sa == 0] = 0
        self.tree = WaveletMatrix(self.bwt, max(1, int(size - 1).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=size))))
        kept = (sa % sample == 0) | (self.bwt == 0)  # a walk never has to pass a 0
        self.kept_rank = np.concatenate(([0], np.cumsum(kept)))
        self.kept = kept
        self.kept_at = sa[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-last row of each pattern (rows of equal length)."""
        last = patterns[:, -1]
        lo, hi = self.before[last].copy(), self.before[last + 1].copy()
        for j in range(patterns.shape[1] - 2, -1, -1):
            live = np.flatnonzero(lo < hi)
            c = patterns[live, j]
            lo[live] = self.before[c] + self.tree.rank(c, lo[live])
            hi[live] = self.before[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, row, todo = np.zeros(len(rows), dtype=np.int64), rows.copy(), np.arange(len(rows))
        while len(todo):
            r = row[todo]
            stop = self.kept[r]
            end = todo[stop]
            at[end] += self.kept_at[self.kept_rank[row[end]]]
            todo, r = todo[~stop], r[~stop]
            c = self.bwt[r]
            row[todo] = self.before[c] + self.tree.rank(c, r)
            at[todo] += 1
        return at


class Patterns:
    """The distinct k-word sequences of items, and which items hold them."""

    def __init__(self, items: list[tuple[int, str]], k: int, code: dict[str, int]):
        self.k = k
        index: dict[tuple[int, ...], int] = {}
        own: list[list[int]] = []
        self.items = np.array([i for i, _ in items], dtype=np.int64)
        self.total = np.zeros(len(items), dtype=np.int64)
        for n, (_, t) in enumerate(items):
            c = [code[w] for w in t.split()]
            seqs = {tuple(c[i : i + k]) for i in range(len(c) - k + 1)}
            self.total[n] = len(seqs)
            for s in seqs:
                if (at := index.setdefault(s, len(own))) == len(own):
                    own.append([])
                own[at].append(n)
        self.rows = np.array(list(index), dtype=np.int64).reshape(-1, k)
        self.first = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)
        self.owner = np.array([n for x in own for n in x], dtype=np.int64)


def _expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... n[0] of them, lo[1], ..."""
    return np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else lo


def vocabulary(items: list[tuple[int, str]]) -> dict[str, int]:
    """Symbol of each word of the items."""
    return {w: i + 1 for i, w in enumerate(sorted({w for _, t in items for w in t.split()}))}


class Shard:
    """Documents (lists of words) under one index; words outside of the vocabulary are symbol 0."""

    def __init__(self, docs: list[list[str]], code: dict[str, int]):
        get, zeros = code.get, repeat(0)
        parts = [np.fromiter(map(get, w, zeros), dtype=np.int64, count=len(w)) for w in docs]
        parts = [x for d in parts for x in (d, np.zeros(1, dtype=np.int64))]
        symbols = np.concatenate(parts)
        self.ends = np.cumsum([len(w) + 1 for w in docs])
        keep = (symbols != 0) | np.concatenate(([True], symbols[:-1] != 0))  # a run of others is one 0
        self.place = np.flatnonzero(keep)
        symbols = symbols[keep]
        if symbols[-1] != 0:
            symbols, self.place = np.append(symbols, 0), np.append(self.place, self.ends[-1] - 1)
        self.index = FMIndex(symbols, len(code) + 1)

    def search(self, p: Patterns) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
        """(document's number, item's number, sequences matched, merged word spans) with at least one match."""
        if not len(p.rows):
            return []
        lo, hi = self.index.search(p.rows)
        n = hi - lo
        at = self.place[self.index.locate(_expand(lo, n))]
        which = np.repeat(np.arange(len(n)), n)
        doc = np.searchsorted(self.ends, at, side="right")
        m = (p.first[1:] - p.first[:-1])[which]
        item = p.owner[_expand(p.first[which], m)]
        doc, which, at = np.repeat(doc, m), np.repeat(which, m), np.repeat(at, m)
        order = np.lexsort((at, item, doc))
        doc, item, which, at = doc[order], item[order], which[order], at[order]
        cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))) if len(doc) else []
        out = []
        for s, e in zip(cut, [*cut[1:], len(doc)]):
            d = int(doc[s])
            a = at[s:e] - (self.ends[d - 1] if d else 0)
            breaks = np.flatnonzero(np.diff(a) > p.k) + 1
            starts, stops = a[np.concatenate(([0], breaks))], a[np.concatenate((breaks - 1, [len(a) - 1]))] + p.k
            out.append((d, int(item[s]), len(np.unique(which[s:e])), list(zip(starts.tolist(), stops.tolist()))))
        return out


def search_shard(docs: list[list[str]], items: list[tuple[int, str]], k: int) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """Shard.search for one block of items."""
    code = vocabulary(items)
    return Shard(docs, code).search(Patterns(items, k, code)) if docs and code else []


SCHEMA = "doc_id long, item_id long, matched long, sequences long, share double, spans array<struct<start:long,stop:long>>"


def leaked(documents: DataFrame, items: DataFrame, k: int = 4, least: float = 0.25) -> DataFrame:
    """doc_id, item_id, matched, sequences, share, spans: documents that hold at least `least` of an item's
    distinct k-word sequences.

    spans are merged word positions [start, stop) in the document's normal words, for removal.
    Null or blank texts hold nothing, items of under k words are held by nothing; repeated
    document rows give repeated results.  Everything about a document is settled in its
    shard, so nothing is shuffled.  A shard is indexed once and searched for ITEMS_AT_ONCE items at a time.
    """
    spark = documents.sparkSession
    rows = (
        items.where("item_id is not null and text is not null")
        .select("item_id", normal_text(F.col("text")).alias("words"))
        .dropDuplicates(["item_id"])
        .orderBy("item_id")
        .toLocalIterator()
    )
    every = [(r[0], r[1]) for r in rows]  # the stated query set
    code = vocabulary(every)
    blocks = [every[i : i + ITEMS_AT_ONCE] for i in range(0, len(every), ITEMS_AT_ONCE)]
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", normal_text(F.col("text")).alias("words"))
    context = spark.sparkContext
    shared = context.broadcast((code, [vars(Patterns(b, k, code)) for b in blocks]))  # bounded by the query set

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, blocks = shared.value
        patterns = []
        for b in blocks:
            p = Patterns.__new__(Patterns)
            vars(p).update(b)
            patterns.append(p)

        def shard(ids: list[int], docs: list[list[str]]) -> Iterator[pa.RecordBatch]:
            index = Shard(docs, code) if docs and code else None
            for p in patterns if index else ():
                hits = [h for h in index.search(p) if h[2] >= least * p.total[h[1]]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[h[0]] for h in hits], pa.int64()),
                        pa.array([p.items[h[1]] for h in hits], pa.int64()),
                        pa.array([h[2] for h in hits], pa.int64()),
                        pa.array([p.total[h[1]] for h in hits], pa.int64()),
                        pa.array([h[2] / p.total[h[1]] for h in hits], pa.float64()),
                        pa.array(
                            [[{"start": a, "stop": b} for a, b in h[3]] for h in hits],
                            pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])),
                        ),
                    ],
                    names=["doc_id", "item_id", "matched", "sequences", "share", "spans"],
                )

        ids, held, n = [], [], 0
        for t in batches:
            for i, w in zip(t.column("doc_id").to_pylist(), t.column("words").to_pylist()):
                w = w.split()
                ids.append(i)
                held.append(w)
                n += len(w)
                if n >= SHARD_WORDS:
                    yield from shard(ids, held)
                    ids, held, n = [], [], 0
        yield from shard(ids, held)

    return docs.mapInArrow(find, SCHEMA)
