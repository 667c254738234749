"""Overlap between splits: joined MinHash rows, seeds, chain and alignment (problem 1).

1. Every text of both sides gives TREES rows over all its k-word sequences: a key of two MinHash values and a sketch
   of BYTES further ones, a byte each.  No sequence is set aside, thinned or left out, however frequent, and no
   run of equal words is needed, so edits may stand anywhere and blocks of words may be moved.
2. Rows of both sides with the same key and AGREE equal bytes at least meet; pairs whose meetings have
   ENOUGH equal bytes together are candidates.  A pair at similarity 0.50 fails to be one with a chance of about
   13 in a million (3,000,000 simulated draws); nothing else can lose a pair, as every meeting of every key is counted.
3. Seeds (common K-word sequences) of a candidate are chained collinearly, the chain is extended over
   substitutions along its diagonals, and a pair with a chain is decided by its exact similarity.

Rows travel packed, 21 bytes each, in one blob for each bucket of keys, and are sorted and compared as arrays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.session import cut_lineage
from .conduct import slices
from .records import expand, record_words
from .verify import MARKS
from .words import WordIds, mix, sequences

K = 5
TREES, BYTES, AGREE, ENOUGH = 64, 12, 4, 5
MANY = 20_000  # pairs of one key beyond which its rows are sorted by pairs of sketch bytes before they are compared
BLOCK = 1024  # BLOCK x BLOCK pairs are compared at a time
BUCKET = 1 << 17  # rows of a bucket, about
FLUSH = 2_000_000
TASK = 1 << 20  # rows of a task that pairs them, about
_ID, _SIZE = 34, 6  # bits of a row's text: of the text's class, of its number of sequences
_STEPS = 4  # a size's code rises by so many when it doubles
_ROW = 21
_LOW, _GOLD = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x9E3779B97F4A7C15)
_PLACES = (0, 1, 8, 9, 16, 17, 24, 25, 32, 40, 48, 56)  # bits that tell which bytes of two sketches are equal: byte / 8 of the first word, or 1 more of the second


def _flat(memo: WordIds, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts, and the start of each text (and the end)."""
    ids = [memo.of(t) for t in texts]
    return np.concatenate(ids) if ids else np.empty(0, np.uint64), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)


def _grams(ids: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word sequences of texts that lie one after another, and the text of each."""
    h = sequences(ids, k)
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = own[: len(h)] == own[k - 1 :] if len(h) else np.empty(0, bool)
    return h[inside], own[: len(h)][inside]


class Functions:
    """The hash functions, two a tree; a tree's sketch takes BYTES of those of other trees."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = 2 * TREES
        self.mul = rng.integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 2**32, n, dtype=np.uint32)
        self.sketch = np.stack([(2 * t + rng.permutation(np.arange(2, n))[:BYTES]) % n for t in range(TREES)])

    def least(self, h: np.ndarray, start: np.ndarray) -> np.ndarray:
        """functions x texts: the minima over each text's sequences, which begin at start."""
        x = (h >> np.uint64(32)).astype(np.uint32)
        return np.stack([np.minimum.reduceat(x * m + a, start) for m, a in zip(self.mul, self.add)])


def signed_rows(functions: Functions, memo: WordIds, texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key (64 bits) and sketch (two words, the second half filled), tree by tree for all texts that have a k-word sequence; which texts, and their size codes."""
    h, own = _grams(*_flat(memo, texts), k)
    if not len(h):
        return np.empty((TREES, 0), np.uint64), np.empty((TREES, 0, 2), np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    _, first = np.unique(mix(h + own.astype(np.uint64) * _GOLD), return_index=True)
    size = np.bincount(own[first], minlength=len(texts))[own[start]]
    low = functions.least(h, start)
    key = mix(mix(low[0::2].astype(np.uint64) * _GOLD + low[1::2]) + np.arange(TREES, dtype=np.uint64)[:, None] * _GOLD)
    low = low * np.uint32(0x85EBCA6B)  # spreads the minima, which are all small
    low = ((low ^ (low >> np.uint32(15))) & np.uint32(0xFF)).astype(np.uint8)
    sketch = np.zeros((TREES, low.shape[1], 16), np.uint8)
    sketch[:, :, :BYTES] = low[functions.sketch].transpose(0, 2, 1)
    sketch = sketch.view(np.uint64)
    return key, sketch, own[start], np.minimum(np.floor(np.log2(size) * _STEPS).astype(np.int64), (1 << _SIZE) - 1)


def _pack(key: np.ndarray, text: np.ndarray, sketch: np.ndarray) -> bytes:
    """Rows sorted by key, byte after byte of all (equal leading bytes lie together)."""
    flat = lambda x, n: np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :n].T
    return np.concatenate((flat(key.astype("<u4"), 4), flat(text.astype("<u8"), 5), flat(sketch.astype("<u8"), BYTES))).tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(data, np.uint8).reshape(_ROW, -1)
    text = np.zeros((x.shape[1], 8), np.uint8)
    text[:, :5] = x[4:9].T
    sketch = np.zeros((x.shape[1], 16), np.uint8)
    sketch[:, :BYTES] = x[9:].T
    return np.ascontiguousarray(x[:4].T).view("<u4")[:, 0], text.view("<i8")[:, 0], sketch.view("<u8")


def _signed(texts: DataFrame, k: int, buckets: int) -> DataFrame:
    """bucket, held, data: packed rows of texts (cls, words, held)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions, memo, seen = Functions(), WordIds(), set()
        waiting: dict[bool, list[tuple[int, str]]] = {False: [], True: []}
        chunk = 16_384

        def blobs(held: bool) -> pa.RecordBatch:
            cls = np.array([c for c, _ in waiting[held]], dtype=np.int64)
            words = [w for _, w in waiting[held]]
            waiting[held] = []
            parts = []
            for a, z in slices([len(w) for w in words], 1_000_000):
                key, sketch, which, size = signed_rows(functions, memo, words[a:z], k)
                text = ((cls[a:z][which] & ((1 << _ID) - 1)) << _SIZE) | size
                parts.append((key.ravel(), np.tile(text, TREES), sketch.reshape(-1, 2)))
            key, text, sketch = (np.concatenate(x) for x in zip(*parts))
            bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            key = key & np.uint64(0xFFFFFFFF)
            order = np.argsort((bucket << np.uint64(32)) | key)
            bucket, key, text, sketch = bucket[order].astype(np.int64), key[order], text[order], sketch[order]
            at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(key) else np.zeros(1, np.int64)
            data = [_pack(key[s:e], text[s:e], sketch[s:e]) for s, e in zip(at, at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]]), pa.array(np.full(len(data), held)), pa.array(data, pa.binary())], names=["bucket", "held", "data"])

        for t in batches:
            for c, w, x in zip(*(t.column(n).to_pylist() for n in ("cls", "words", "held"))):
                if (c, x) in seen:  # copies within a task are signed once
                    continue
                seen.add((c, x))
                waiting[x].append((c, w))
                if len(waiting[x]) == chunk:
                    yield blobs(x)
            if len(seen) > FLUSH:
                seen.clear()
        for x in (False, True):
            if waiting[x]:
                yield blobs(x)

    return texts.select("cls", "words", "held").mapInArrow(sign, "bucket long, held boolean, data binary")


def _equal_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits at _PLACES of the bytes in which sketches x and y are equal."""
    z = x ^ y
    same = ~(((z & _LOW) + _LOW) | z | _LOW)  # the high bit of each byte
    return (same[:, 0] >> np.uint64(7)) | ((same[:, 1] & np.uint64(0xFFFFFFFF)) >> np.uint64(6))


def _pairs_of_runs(run: np.ndarray, held: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of both sides that have the same run, at most BLOCK x BLOCK pairs at a time; sorted by run, then side."""
    start = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.empty(0, np.int64)
    n = np.diff(np.append(start, len(run)))
    b = np.add.reduceat(held.astype(np.int64), start) if len(run) else n
    a = n - b
    some = a * b > 0
    start, a, b = start[some], a[some], b[some]
    end = np.cumsum(a * b)
    for at in range(0, int(end[-1]) if len(end) else 0, BLOCK * BLOCK):
        k = np.arange(at, min(at + BLOCK * BLOCK, end[-1]))
        of = np.searchsorted(end, k, side="right")
        k -= end[of] - a[of] * b[of]
        yield rows[start[of] + k // b[of]], rows[start[of] + a[of] + k % b[of]]


def met(key: np.ndarray, held: np.ndarray, text: np.ndarray, sketch: np.ndarray, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of both sides whose rows have the same key, AGREE equal bytes at least and sizes at most steps apart; the number of equal bytes.

    A key with more than MANY pairs is sorted by each two bytes instead: rows that meet are equal in two,
    and are taken where these are the first two.
    """
    order = np.argsort(key)
    at = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    n = np.diff(np.append(at, len(key)))
    b = np.add.reduceat(held[order].astype(np.int64), at)
    order = order[np.repeat((b > 0) & (b < n), n)]  # keys of both sides
    key, held, text, sketch = key[order], held[order], text[order], sketch[order]
    order = np.lexsort((text, (key << np.uint64(1)) | held))
    key, held, text, sketch = key[order], held[order], text[order], sketch[order]
    new = np.ones(len(key), bool)  # a text that several tasks signed counts once
    new[1:] = (key[1:] != key[:-1]) | (held[1:] != held[:-1]) | (text[1:] != text[:-1])
    key, held, text, sketch = key[new], held[new], text[new], sketch[new]
    if not len(key):
        return
    run = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
    b = np.bincount(run, weights=held).astype(np.int64)
    many = ((np.bincount(run) - b) * b > MANY)[run]

    def out(x: np.ndarray, y: np.ndarray, same: np.ndarray, keep: np.ndarray | bool = True):
        n = np.bitwise_count(same)
        apart = np.abs((text[x] & ((1 << _SIZE) - 1)) - (text[y] & ((1 << _SIZE) - 1)))
        last = (1 << _SIZE) - 1  # the last code holds all larger sizes
        near = (apart <= steps) | ((text[x] & last) == last) | ((text[y] & last) == last)
        keep = keep & (n >= AGREE) & near
        return text[x[keep]] >> _SIZE, text[y[keep]] >> _SIZE, n[keep].astype(np.int64)

    few = np.flatnonzero(~many)
    for x, y in _pairs_of_runs(run[few], held[few], few):
        yield out(x, y, _equal_bytes(sketch[x], sketch[y]))
    hot = np.flatnonzero(many)
    if len(hot):
        byte = {i: (sketch[hot, i % 8] >> np.uint64(i - i % 8)) & np.uint64(0xFF) for i in _PLACES}
        for i, j in combinations(_PLACES[: BYTES - AGREE + 2], 2):  # two of AGREE bytes are among these
            own = (run[hot].astype(np.uint64) << np.uint64(16)) | (byte[i] << np.uint64(8)) | byte[j]
            order = np.lexsort((held[hot], own))
            for x, y in _pairs_of_runs(own[order], held[hot][order], hot[order]):
                same = _equal_bytes(sketch[x], sketch[y])
                first, rest = same & -same, same & (same - np.uint64(1))
                yield out(x, y, same, (first == np.uint64(1 << i)) & ((rest & -rest) == np.uint64(1 << j)))


def _met(rows: DataFrame, least: float) -> DataFrame:
    """Of packed rows: low_a, low_b (the low bits of the classes), n of every meeting."""
    steps = int(np.ceil(_STEPS * np.log2(1 / least)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        count, last = 0, None

        def settle() -> Iterator[pa.RecordBatch]:
            key, text, sketch, held = [], [], [], []
            for bucket, side, data in waiting:
                k, t, s = _unpack(data)
                key.append((np.uint64(bucket) << np.uint64(32)) | k)
                text.append(t)
                sketch.append(s)
                held.append(np.full(len(k), side))
            for a, b, n in met(*(np.concatenate(x) for x in (key, held, text, sketch)), steps):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n.astype(np.int8))], names=["low_a", "low_b", "n"])

        for t in batches:
            for bucket, side, data in zip(t.column("bucket").to_pylist(), t.column("held").to_pylist(), t.column("data")):
                if bucket != last and count >= BUCKET:  # small buckets are taken together
                    yield from settle()
                    waiting, count = [], 0
                last = bucket
                waiting.append((bucket, side, data.as_py()))
                count += len(waiting[-1][2]) // _ROW
        if waiting:
            yield from settle()

    return rows.mapInArrow(meet, "low_a long, low_b long, n tinyint")


def candidates(train: DataFrame, held: DataFrame, k: int = 3, least: float = 0.5) -> DataFrame:
    """cls_a (train), cls_b (held out), words_a, words_b of the texts that meet often enough."""
    texts = train.select("cls", "words", F.lit(False).alias("held")).unionByName(held.select("cls", "words", F.lit(True).alias("held")))
    n = (train.count() + held.count()) * TREES
    tasks = n // TASK  # where the session has fewer, a task would have to hold more
    parts = (tasks,) if tasks > int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()
    rows = _signed(texts, k, max(1, n // BUCKET)).repartition(*parts, "bucket").sortWithinPartitions("bucket")
    pairs = cut_lineage(_met(rows, least).groupBy("low_a", "low_b").agg(F.sum("n").alias("_n")).where(F.col("_n") >= ENOUGH).select("low_a", "low_b"))
    return _gathered(pairs, texts)


def _gathered(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """cls_a, cls_b, words_a, words_b of pairs (low_a, low_b): of all classes that have these low bits on their side.

    Only texts that stand in a pair are gathered, once.  Marks as in `with_texts`.
    """
    need = pairs.select(F.explode(F.array("low_a", "low_b")).alias("low")).distinct()
    mark = F.pmod(F.xxhash64("low"), F.lit(MARKS))
    marks = need.select(mark.alias("_mark")).distinct()
    low = texts.withColumn("low", F.col("cls").bitwiseAND((1 << _ID) - 1))
    some = low.withColumn("_mark", mark).join(F.broadcast(marks), "_mark", "left_semi").join(need, "low", "left_semi")
    one = cut_lineage(some.groupBy("low", "cls").agg(F.first("words").alias("words"), F.max("held").alias("_b"), F.max(~F.col("held")).alias("_a")))
    side = lambda x: one.where(f"_{x}").select(F.col("low").alias(f"low_{x}"), F.col("cls").alias(f"cls_{x}"), F.col("words").alias(f"words_{x}"))
    return pairs.join(side("a"), "low_a").join(side("b"), "low_b").select("cls_a", "cls_b", "words_a", "words_b")


def _chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of seeds that rises in both texts."""
    ends: list[int] = []
    tails: list[int] = []
    back: list[int] = []
    seeds = sorted(seeds, key=lambda s: (s[0], -s[1]))
    for i, (_, y) in enumerate(seeds):
        j = bisect_left(ends, y)
        back.append(tails[j - 1] if j else -1)
        if j == len(ends):
            ends.append(y)
            tails.append(i)
        else:
            ends[j], tails[j] = y, i
    out, i = [], tails[-1] if tails else -1
    while i >= 0:
        out.append(seeds[i])
        i = back[i]
    return out[::-1]


def _extend(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]]) -> int:
    """Words of a covered when each seed grows along its diagonal, over single substitutions."""
    covered = np.zeros(len(a), dtype=bool)
    on: dict[int, list[int]] = {}
    for x, y in sorted(seeds):
        on.setdefault(x - y, []).append(x)
    for d, xs in on.items():
        lo, hi = max(0, d), min(len(a), len(b) + d)
        same = a[lo:hi] == b[lo - d : hi - d]
        bridged = same.copy()
        bridged[1:-1] |= same[:-2] & same[2:]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], bridged.view(np.int8), [0]))))
        for s, e in zip(edges[::2], edges[1::2]):
            i = bisect_left(xs, lo + s)
            if i < len(xs) and xs[i] < lo + e:
                covered[lo + s : lo + e] |= same[s:e]
    return int(covered.sum())


def _common(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Places in a and in b of the sequences that both have (the first of each), and how many distinct ones each has."""
    (p, at_a), (q, at_b) = np.unique(sequences(a, k), return_index=True), np.unique(sequences(b, k), return_index=True)
    _, i, j = np.intersect1d(p, q, assume_unique=True, return_indices=True)
    return at_a[i], at_b[j], len(p), len(q)


def _aligned(pairs: DataFrame, k: int, least: float) -> DataFrame:
    """Candidates (cls_a, cls_b, words_a, words_b) with a chain and similarity of at least least; coverage of b by the chain."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordIds()
        for t in batches:
            out = []
            for ca, cb, wa, wb in zip(*(t.column(c).to_pylist() for c in ("cls_a", "cls_b", "words_a", "words_b"))):
                a, b = memo.of(wa), memo.of(wb)
                x, y, p, q = _common(a, b, k)
                if not p or not q or len(x) < least * (p + q - len(x)):
                    continue
                seeds = _common(a, b, K)[:2]
                if not len(seeds[0]):  # texts of a few words
                    seeds = x, y
                chain = _chain(list(zip(seeds[1].tolist(), seeds[0].tolist())))
                if chain:
                    out.append((ca, cb, len(x) / (p + q - len(x)), _extend(b, a, chain) / len(b), len(chain)))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], names=["cls_a", "cls_b", "similarity", "coverage", "chained"])

    return pairs.select("cls_a", "cls_b", "words_a", "words_b").mapInArrow(check, "cls_a long, cls_b long, similarity double, coverage double, chained long")


def overlapping_classes(train: DataFrame, held: DataFrame, k: int = 3, least: float = 0.5) -> DataFrame:
    """cls_a (train), cls_b (held out), similarity, coverage, chained.

    train and held have cls and words; least is 0.5 or more.  Equal texts are compared like any other; texts of
    under k words are similar to nothing.  coverage: share of the held-out text's words that the chain covers.
    """
    if least < 0.5 or k > 3:
        raise ValueError("candidates are made for similarities of at least 0.5 and sequences of at most three words")
    return _aligned(candidates(train, held, k, least), k, least)


def overlapping_records(train: DataFrame, held: DataFrame, k: int = 3, least: float = 0.5) -> DataFrame:
    """record_id_a < record_id_b: pairs of a training and a held-out record that overlap.

    Repeated rows of a record count once; null contents are empty.
    """
    a, b = record_words(train), record_words(held)
    near = cut_lineage(overlapping_classes(a, b, k, least).select("cls_a", "cls_b"))
    return expand(near, a.select("record_id", "cls").distinct(), b.select("record_id", "cls").distinct()).distinct()


def covered_records(train: DataFrame, held: DataFrame, split: Column | str = "split", source: Column | str = "source", **kw) -> DataFrame:
    """record_id, split, source, pairs, coverage of every held-out record; null sources stay null.

    pairs: overlapping training records; coverage: the most of the record that one training text covers, 0 where
    none overlaps.
    """
    a, b = record_words(train), record_words(held)
    near = cut_lineage(overlapping_classes(a, b, **kw))
    copies = a.select("record_id", "cls").distinct().groupBy("cls").agg(F.count("*").alias("n")).withColumnRenamed("cls", "cls_a")
    best = near.join(copies, "cls_a").groupBy("cls_b").agg(F.max("coverage").alias("coverage"), F.sum("n").alias("n"))
    own = held.where("record_id is not null").groupBy("record_id").agg(F.min(split).alias("split"), F.min(source).alias("source"))
    rows = own.join(b.select("record_id", F.col("cls").alias("cls_b")).distinct(), "record_id").join(best, "cls_b", "left")
    return rows.select("record_id", "split", "source", F.coalesce("n", F.lit(0)).cast("long").alias("pairs"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def overlap_report(train: DataFrame, held: DataFrame, split: Column | str = "split", source: Column | str = "source", **kw) -> DataFrame:
    """split, source, records, leaked, pairs, mean_coverage: of the held-out records; null sources form a group.

    mean_coverage is the mean of the leaked records' coverage.
    """
    c = covered_records(train, held, split, source, **kw)
    return c.groupBy("split", "source").agg(
        F.count("*").alias("records"),
        F.count_if(F.col("pairs") > 0).alias("leaked"),
        F.sum("pairs").alias("pairs"),
        F.round(F.avg(F.when(F.col("pairs") > 0, F.col("coverage"))), 4).alias("mean_coverage"),
    )
