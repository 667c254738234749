"""Nearest-neighbour search over a vector table: exact, by cells (IVF), and on product codes (PQ).

A datastore has key_id long and key array<float>; queries have qid and qv.  Queries are a
stated set and are taken in blocks of QUERY_BLOCK; the datastore streams past each block
and every task keeps the best k for each query, so what is shuffled is tasks x queries x k.
Vectors that are null or of another length than the first query's are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordinals import bounded_sample

QUERY_BLOCK = 2_048
CELL_BLOCK = 4_096
CHUNK = 1_024
METRICS = ("l2", "dot")


def check_metric(name: str) -> str:
    if str(name).lower() not in METRICS:
        raise ValueError(f"metric {name!r} is none of {METRICS}")
    return name.lower()


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Squared L2 distance, or the inner product, of two vectors; summed in order, in double."""
    d = lambda x: x.cast("double")
    pair = (lambda x, y: (d(x) - d(y)) * (d(x) - d(y))) if check_metric(metric) == "l2" else (lambda x, y: d(x) * d(y))
    return F.aggregate(F.zip_with(a, b, pair), F.lit(0.0), lambda s, x: s + x)


def nearness(dist: Column, metric: str = "l2") -> Column:
    """Larger is nearer: minus the distance, or the inner product itself."""
    return -dist if check_metric(metric) == "l2" else dist


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the vectors that have `dim` elements, and the rows' numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    good = np.flatnonzero((size == dim) & ~np.asarray(column.is_null()))
    flat = np.asarray(column.values.to_numpy(zero_copy_only=False), dtype=np.float64)
    at = column.offsets.to_numpy()[:-1][good]
    return flat[at[:, None] + np.arange(dim)] if len(good) else np.empty((0, dim)), good


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, vectors = [], []
    for r in queries.where("qid is not null and qv is not null").select("qid", "qv").toLocalIterator():
        if vectors and len(r[1]) != len(vectors[0]):
            continue
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids, dtype=np.int64), np.array(vectors, dtype=np.float64)
            ids, vectors = [], []
    if ids:
        yield np.array(ids, dtype=np.int64), np.array(vectors, dtype=np.float64)


def exact_search(queries: DataFrame, store: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """qid, key_id, dist, rank (from 1): the k nearest keys of each query; ties by key_id.

    Fewer than k keys give fewer rows.  dist is the squared L2 distance or the inner product.
    """
    metric = check_metric(metric)
    out = None
    for ids, q in _blocks(queries):
        shared = store.sparkSession.sparkContext.broadcast((ids, q))  # at most QUERY_BLOCK vectors

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best_d, best_k = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), dtype=np.int64)
            for t in batches:
                x, good = _matrix(t.column("key"), q.shape[1])
                keys = t.column("key_id").to_numpy(zero_copy_only=False)[good].astype(np.int64)
                for at in range(0, len(x), CHUNK):
                    part = x[at : at + CHUNK]
                    if metric == "l2":
                        d = np.zeros((len(q), len(part)))
                        for j in range(q.shape[1]):  # in order, as a sum over the vector would run
                            d += (q[:, j, None] - part[None, :, j]) ** 2
                    else:
                        d = np.zeros((len(q), len(part)))
                        for j in range(q.shape[1]):
                            d -= q[:, j, None] * part[None, :, j]
                    d = np.concatenate((best_d, d), axis=1)
                    n = np.concatenate((best_k, np.broadcast_to(keys[at : at + CHUNK], (len(q), len(part)))), axis=1)
                    order = np.lexsort((n, d), axis=1)[:, :k]
                    best_d, best_k = np.take_along_axis(d, order, 1), np.take_along_axis(n, order, 1)
            m = best_d.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, m)), pa.array(best_k.ravel()), pa.array(best_d.ravel() if metric == "l2" else -best_d.ravel())],
                names=["qid", "key_id", "dist"],
            )

        part = store.where("key_id is not null").select("key_id", "key").mapInArrow(search, "qid long, key_id long, dist double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = store.sparkSession.createDataFrame([], "qid long, key_id long, dist double")
    return top_k(out, k, metric)


def top_k(hits: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Adds rank and keeps the k nearest of each qid (partial limit before the shuffle by the engine's window group limit)."""
    d = F.col("dist") if check_metric(metric) == "l2" else -F.col("dist")
    w = Window.partitionBy("qid").orderBy(d, "key_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recomputed(hits: DataFrame, queries: DataFrame, store: DataFrame, metric: str = "l2") -> DataFrame:
    """hits (qid, key_id, ...) with dist from the true vectors."""
    return (
        hits.drop("dist").join(queries.select("qid", "qv"), "qid").join(store.select("key_id", "key"), "key_id")
        .withColumn("dist", distance(F.col("qv"), F.col("key"), metric)).drop("qv", "key")
    )


def mean_centroids(store: DataFrame, group: str = "val") -> DataFrame:
    """cell_id, centroid: element-wise means of the keys of each group."""
    e = store.where(F.col(group).isNotNull()).select(F.col(group).cast("long").alias("cell_id"), F.posexplode("key").alias("i", "x"))
    m = e.groupBy("cell_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("_c")).select("cell_id", F.transform("_c", lambda s: s["m"]).alias("centroid"))


def assign_cells(vectors: DataFrame, centroids: DataFrame, id_col: str = "key_id", vec: str = "key", nearest: int = 1) -> DataFrame:
    """id, cell_id, dist, rank: the nearest cells of each vector; ties by cell_id.

    Centroids are sent to the tasks in blocks of CELL_BLOCK; with several blocks each gives its
    nearest ones and the best of those stay.
    """
    out, blocks, ids, rows = None, 0, [], []

    def near(shared):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, c = shared.value
            for t in batches:
                x, good = _matrix(t.column("vec"), c.shape[1])
                own = t.column("id").to_numpy(zero_copy_only=False)[good].astype(np.int64)
                for at in range(0, len(x), CHUNK):
                    part = x[at : at + CHUNK]
                    d = np.zeros((len(part), len(c)))
                    for j in range(c.shape[1]):
                        d += (part[:, j, None] - c[None, :, j]) ** 2
                    order = np.argsort(d, axis=1, kind="stable")[:, :nearest]
                    m = order.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(own[at : at + CHUNK], m)),
                            pa.array(ids[order].ravel()),
                            pa.array(np.take_along_axis(d, order, 1).ravel()),
                            pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(part))),
                        ],
                        names=[id_col, "cell_id", "dist", "rank"],
                    )

        return find

    src = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    schema = f"{id_col} long, cell_id long, dist double, rank int"

    def block() -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast((np.array(ids, dtype=np.int64), np.array(rows, dtype=np.float64)))
        return src.mapInArrow(near(shared), schema)

    for r in centroids.orderBy("cell_id").select("cell_id", "centroid").toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == CELL_BLOCK:
            part, ids, rows, blocks = block(), [], [], blocks + 1
            out = part if out is None else out.unionByName(part)
    if ids:
        part, blocks = block(), blocks + 1
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], schema)
    if blocks == 1:
        return out
    w = Window.partitionBy(id_col).orderBy("dist", "cell_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= nearest)


def in_cells(store: DataFrame, centroids: DataFrame) -> DataFrame:
    """key_id, key, cell_id: every vector with its nearest cell.  With up to CELL_BLOCK cells vectors aren't shuffled."""
    if centroids.limit(CELL_BLOCK + 1).count() > CELL_BLOCK:
        return store.select("key_id", "key").join(assign_cells(store, centroids).select("key_id", "cell_id"), "key_id")
    rows = centroids.orderBy("cell_id").select("cell_id", "centroid").collect()  # at most CELL_BLOCK
    shared = store.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = shared.value
        for t in batches:
            if not len(ids):
                continue
            x, good = _matrix(t.column("key"), c.shape[1])
            own = np.empty(len(x), dtype=np.int64)
            for at in range(0, len(x), CHUNK):
                own[at : at + CHUNK] = ids[_distances(x[at : at + CHUNK], c, "l2").argmin(axis=1)]
            t = t.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([t.column("key_id"), t.column("key"), pa.array(own)], names=["key_id", "key", "cell_id"])

    src = store.where("key_id is not null").select(F.col("key_id").cast("long").alias("key_id"), "key")
    return src.mapInArrow(find, f"key_id long, key {src.schema['key'].dataType.simpleString()}, cell_id long")


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Squared distances (or minus inner products) of all rows of a and b, summed in order of the dimensions."""
    d = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d += (a[:, j, None] - b[None, :, j]) ** 2 if metric == "l2" else -a[:, j, None] * b[None, :, j]
    return d


def ivf_search(queries: DataFrame, store: DataFrame | None, centroids: DataFrame, k: int, nprobe: int, vectors: DataFrame | None = None, metric: str = "l2") -> DataFrame:
    """qid, key_id, dist, rank: the k nearest keys among those of each query's nprobe nearest cells.

    vectors: key_id, key, cell_id as kept by an index (found from store if absent); where they are
    partitioned by cell only probed cells are read.  Queries go to the tasks in blocks, vectors stay where they are, and distances
    are computed cell by cell as matrices.  With all cells probed it equals the exact search.
    """
    metric = check_metric(metric)
    vectors = in_cells(store, centroids) if vectors is None else vectors
    probes = assign_cells(queries, centroids, "qid", "qv", nprobe).groupBy("qid").agg(F.collect_list("cell_id").alias("probes"))  # nprobe each
    asked = queries.where("qv is not null").select("qid", "qv").join(probes, "qid")
    out, block = None, []

    def scan(block: list) -> DataFrame:
        cells = sorted({c for r in block for c in r[2]})
        shared = queries.sparkSession.sparkContext.broadcast((np.array([r[0] for r in block]), np.array([r[1] for r in block], dtype=np.float64), [set(r[2]) for r in block]))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, wanted = shared.value
            by_cell: dict[int, np.ndarray] = {c: np.array([i for i, w in enumerate(wanted) if c in w]) for c in set().union(*wanted)}
            best_d, best_k = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, dtype=np.int64)
            for t in batches:
                x, good = _matrix(t.column("key"), q.shape[1])
                keys = t.column("key_id").to_numpy(zero_copy_only=False)[good]
                cell = t.column("cell_id").to_numpy(zero_copy_only=False)[good]
                for c in np.unique(cell).tolist():
                    rows, who = np.flatnonzero(cell == c), by_cell.get(c)
                    for at in range(0, len(rows) if who is not None else 0, CHUNK):
                        part = rows[at : at + CHUNK]
                        d = np.concatenate((best_d[who], _distances(q[who], x[part], metric)), axis=1)
                        n = np.concatenate((best_k[who], np.broadcast_to(keys[part], (len(who), len(part)))), axis=1)
                        order = np.lexsort((n, d), axis=1)[:, :k]
                        best_d[who], best_k[who] = np.take_along_axis(d, order, 1), np.take_along_axis(n, order, 1)
            kept = np.isfinite(best_d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, kept.sum(axis=1))), pa.array(best_k[kept]), pa.array(best_d[kept] if metric == "l2" else -best_d[kept])], names=["qid", "key_id", "dist"]
            )

        return vectors.where(F.col("cell_id").isin(cells)).select("key_id", "key", "cell_id").mapInArrow(search, "qid long, key_id long, dist double")

    for r in asked.toLocalIterator():  # the stated query set
        block.append(r)
        if len(block) == QUERY_BLOCK:
            part, block = scan(block), []
            out = part if out is None else out.unionByName(part)
    if block:
        part = scan(block)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = queries.sparkSession.createDataFrame([], "qid long, key_id long, dist double")
    return top_k(out, k, metric)


def recall_at_k(found: DataFrame, truth: DataFrame) -> DataFrame:
    """qid, recall: share of the true neighbours that were found."""
    hit = found.select("qid", "key_id").withColumn("_hit", F.lit(1))
    return truth.select("qid", "key_id").join(hit, ["qid", "key_id"], "left").groupBy("qid").agg((F.count("_hit") / F.count("*")).alias("recall"))


def train_sample(store: DataFrame, rows: int, seed: int = 1) -> np.ndarray:
    """At most `rows` vectors by seeded hash of the key; the bound of what the driver holds."""
    s = bounded_sample(store.where("key is not null and key_id is not null"), "key_id", rows, seed)
    return np.array([r[0] for r in s.select("key").collect()], dtype=np.float64)


def lloyd(x: np.ndarray, k: int, iterations: int = 20, seed: int = 1) -> np.ndarray:
    """k-means centroids of a sample; an emptied cell is given the farthest point."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(iterations):
        d = (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]
        own = d.argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        for e in np.flatnonzero(n == 0):
            c[e] = x[d.min(1).argmax()]
    return c


def train_cells(store: DataFrame, cells: int, sample: int = 100_000, iterations: int = 20, seed: int = 1) -> DataFrame:
    """cell_id, centroid by k-means on a bounded sample."""
    c = lloyd(train_sample(store, sample, seed), cells, iterations, seed)
    return store.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "cell_id long, centroid array<double>")


def train_product_codes(store: DataFrame, cells: DataFrame, parts: int, codes: int = 256, sample: int = 50_000, seed: int = 1) -> np.ndarray:
    """parts x codes x (dim/parts) sub-vectors of residuals, trained on a bounded sample."""
    x = train_sample(store, sample, seed)
    c = np.array([r["centroid"] for r in cells.orderBy("cell_id").collect()])
    own = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]).argmin(1)
    r = (x - c[own]).reshape(len(x), parts, -1)
    n = min(codes, len(x))
    return np.stack([lloyd(r[:, m], n, 10, seed + m) for m in range(parts)])


def encode_product(store: DataFrame, cells: DataFrame, book: np.ndarray) -> DataFrame:
    """key_id, cell_id, codes: every key's cell and the nearest sub-vector of each part of its residual."""
    rows = cells.orderBy("cell_id").collect()
    shared = store.sparkSession.sparkContext.broadcast((np.array([r["cell_id"] for r in rows]), np.array([r["centroid"] for r in rows]), book))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c, book = shared.value
        for t in batches:
            x, good = _matrix(t.column("key"), c.shape[1])
            own = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]).argmin(1) if len(x) else np.empty(0, np.int64)
            r = (x - c[own]).reshape(len(x), len(book), -1)
            code = [((r[:, m] ** 2).sum(1)[:, None] - 2 * r[:, m] @ book[m].T + (book[m] ** 2).sum(1)[None]).argmin(1) if len(x) else np.empty(0, np.int64) for m in range(len(book))]
            flat = np.stack(code, 1).astype(np.int16) if len(x) else np.empty((0, len(book)), np.int16)
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.column("key_id").to_numpy(zero_copy_only=False)[good].astype(np.int64)), pa.array(ids[own].astype(np.int64)), pa.array(list(flat), pa.list_(pa.int16()))],
                names=["key_id", "cell_id", "codes"],
            )

    return store.where("key_id is not null").select("key_id", "key").mapInArrow(encode, "key_id long, cell_id long, codes array<smallint>")


def product_search(queries: DataFrame, codes: DataFrame, cells: DataFrame, book: np.ndarray, k: int, nprobe: int) -> DataFrame:
    """qid, key_id, dist, rank by asymmetric distances: a table of each query's residual to all sub-vectors, summed over a key's codes."""
    rows = cells.orderBy("cell_id").collect()
    place = {r["cell_id"]: i for i, r in enumerate(rows)}
    shared = queries.sparkSession.sparkContext.broadcast((place, np.array([r["centroid"] for r in rows]), book))
    probes = assign_cells(queries, cells, "qid", "qv", nprobe).select("qid", "cell_id")
    pairs = probes.join(queries.select("qid", "qv"), "qid").join(codes, "cell_id").select("qid", "cell_id", "qv", "key_id", "codes")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, c, book = shared.value
        parts = np.arange(len(book))
        for t in batches:
            table: dict[tuple[int, int], np.ndarray] = {}
            q, cell = t.column("qid").to_pylist(), t.column("cell_id").to_pylist()
            qv, code = t.column("qv"), t.column("codes").to_pylist()
            d = np.empty(len(q))
            for i, (a, b) in enumerate(zip(q, cell)):
                if (a, b) not in table:
                    r = (np.array(qv[i].as_py(), dtype=np.float64) - c[place[b]]).reshape(len(book), 1, -1)
                    table[a, b] = ((r - book) ** 2).sum(2)
                d[i] = table[a, b][parts, code[i]].sum()
            yield pa.RecordBatch.from_arrays([t.column("qid"), t.column("key_id"), pa.array(d)], names=["qid", "key_id", "dist"])

    return top_k(pairs.mapInArrow(score, "qid long, key_id long, dist double"), k)
