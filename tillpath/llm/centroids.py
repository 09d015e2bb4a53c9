"""Centroid clustering by Lloyd's rounds, sharded by dimension.

Vectors are cut into blocks of columns. A row of the slice table holds one block of a chunk of some hundred
vectors, as whole numbers. In each round

1. a task for a column block works out the exact squared distances of its vectors from its slice of the
   centroids, and of no other columns;
2. these partial distances are added up by chunk, one row for each block, and the least is taken;
3. each block's sums by cluster are added up, and each block updates its own slice of the centroids.

What moves are partial distances (two, four or eight bytes each, as they need) and, for the update, the slices, which
take a byte for each component of a unit vector. The driver holds the centroids alone: clusters times dimensions.
Everything is whole-number arithmetic, so results don't depend on the order of rows or tasks.

Kept are vectors of exactly ``dims`` components, none null, infinite or not a number. A component beyond 2**27 times 1/64 in size
raises an error, as its square would not be exact. Repeated rows count each on their own, also when centroids are
chosen; ties go to the smaller cluster. Vectors without an id are clustered like others, and chosen last to be
centroids. With fewer vectors than clusters there are fewer clusters, and an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpath.llm.common import kept

BLOCK_DIMS = 16
CHUNK_ROWS = 512
"""Vectors whose blocks are rows of their own; bounds what is added up at a time."""
GRID = 64
"""Components are counted in steps of 1/64."""
LARGEST = 1 << 27

SLICES = "chunk long, block int, rows int, width int, data binary"
PARTS = "chunk long, rows int, width int, data binary"
ASSIGNED = "chunk long, clusters array<int>, distances array<bigint>"
SUMS = "block int, cluster int, dim int, rows long, total long"


def on_grid(component: Column) -> Column:
    return F.floor(component.cast("double") * GRID)


def whole_vectors(embeddings: DataFrame, dims: int, vec_id: str, embedding: str) -> DataFrame:
    """(id, xs): the vectors that are kept, with components as whole numbers."""
    xs = F.col(embedding)
    # NaN is larger than infinity in Spark's order.
    whole = F.forall(xs, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    fits = (F.size(xs) == dims) & whole
    return embeddings.where(F.coalesce(fits, F.lit(False))).select(
        F.col(vec_id).alias("id"), F.transform(xs, on_grid).alias("xs")
    )


def first_centroids(vectors: DataFrame, clusters: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    first = vectors.orderBy(hashed.asc_nulls_last(), "xs").limit(clusters).select("xs").collect()
    return np.array([r["xs"] for r in first], np.int64)


def packed(values: np.ndarray) -> tuple[int, bytes]:
    """The bytes of whole numbers in the narrowest width that holds them all."""
    least, most = (int(values.min()), int(values.max())) if values.size else (0, 0)
    for width in (1, 2, 4):
        if -(1 << 8 * width - 1) <= least and most < 1 << 8 * width - 1:
            return width, values.astype(f"<i{width}").tobytes()
    return 8, values.astype("<i8").tobytes()


def unpacked(width: int, data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(rows, -1).astype(np.int64)


def sliced(vectors: DataFrame, dims: int, block_dims: int) -> DataFrame:
    """The slice table, and in the rows of block 0 the ids of the chunk's vectors."""
    id_type = vectors.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0)
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            if values.size and np.abs(values).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} / {GRID}, so its distances would not be exact")
            out = []
            for start in range(0, len(values), CHUNK_ROWS):
                part = values[start : start + CHUNK_ROWS]
                for block, low in enumerate(range(0, dims, block_dims)):
                    width, data = packed(part[:, low : low + block_dims])
                    here = ids.slice(start, len(part)) if block == 0 else None
                    out.append((chunk, block, len(part), width, data, here))
                chunk += 1
            columns = [pa.array(x, t) for x, t in zip(list(zip(*out))[:5], types)] if out else []
            if out:
                lists = [None if x[5] is None else x[5].to_pylist() for x in out]
                columns.append(pa.array(lists, pa.list_(ids.type)))
                yield pa.RecordBatch.from_arrays(columns, [*names, "ids"])

    names = ["chunk", "block", "rows", "width", "data"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return vectors.mapInArrow(run, f"{SLICES}, ids array<{id_type.simpleString()}>")


def partial_distances(slices: DataFrame, centroids: np.ndarray, block_dims: int) -> DataFrame:
    """A row for each block of a chunk: the squared distances in its columns from every centroid."""
    by_block = [centroids[:, low : low + block_dims] for low in range(0, centroids.shape[1], block_dims)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunk, block, rows, width, data in zip(*(c.to_pylist() for c in batch.columns)):
                x, c = unpacked(width, data, rows), by_block[block]
                parts = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
                out.append((chunk, rows, *packed(parts)))
            columns = [pa.array(x, t) for x, t in zip(zip(*out), types)]
            if out:
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "rows", "width", "data"])

    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return slices.select("chunk", "block", "rows", "width", "data").mapInArrow(run, PARTS)


def nearest(parts: DataFrame) -> DataFrame:
    """(chunk, clusters, distances): the blocks' partial distances added up, and the least of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunk, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = sum(unpacked(b["width"], b["data"], b["rows"]) for b in blocks)
                best = total.argmin(1)
                out.append((chunk, best.astype(np.int32), total[np.arange(len(best)), best]))
            if out:
                columns = [pa.array(x, t) for x, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "clusters", "distances"])

    types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    # As many rows in a group as there are blocks, of one chunk's size each.
    chunks = parts.groupBy("chunk").agg(F.collect_list(F.struct("rows", "width", "data")).alias("blocks"))
    return chunks.mapInArrow(run, ASSIGNED)


def updated(slices: DataFrame, assigned: DataFrame, centroids: np.ndarray, block_dims: int) -> np.ndarray:
    """The centroids after each block has updated its own slice; those without vectors stay."""
    clusters = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, rows, width, data, to in zip(*(c.to_pylist() for c in batch.columns)):
                x = unpacked(width, data, rows)
                if block not in sums:
                    sums[block] = np.zeros((clusters, x.shape[1]), np.int64)
                    counts[block] = np.zeros(clusters, np.int64)
                np.add.at(sums[block], to, x)
                counts[block] += np.bincount(to, minlength=clusters)
        for block, total in sums.items():
            used = np.flatnonzero(counts[block])
            width = total.shape[1]
            columns = [
                pa.array(np.full(len(used) * width, block, np.int32)),
                pa.array(np.repeat(used, width).astype(np.int32)),
                pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))),
                pa.array(np.repeat(counts[block][used], width)),
                pa.array(total[used].ravel()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "cluster", "dim", "rows", "total"])

    joined = slices.join(assigned.select("chunk", "clusters"), "chunk")
    sums = joined.select("block", "rows", "width", "data", "clusters").mapInArrow(run, SUMS)
    sums = sums.groupBy("block", "cluster", "dim").agg(F.sum("rows").alias("n"), F.sum("total").alias("s"))
    floor = F.expr("(s - pmod(s, n)) DIV n").alias("x")
    moved = centroids.copy()
    # One number for each cluster and dimension.
    for r in sums.select("block", "cluster", "dim", floor).collect():
        moved[r["cluster"], r["block"] * block_dims + r["dim"]] = r["x"]
    return moved


def cluster(
    embeddings: DataFrame,
    clusters: int = 16,
    rounds: int = 3,
    dims: int = 64,
    block_dims: int = BLOCK_DIMS,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) for every kept vector, final centroids).

    Distances are squared, in steps of the grid, from the final centroids.
    """
    vectors = whole_vectors(embeddings, dims, vec_id, embedding)
    centroids = first_centroids(vectors, clusters)
    if not len(centroids):
        return vectors.select(F.col("id").alias(vec_id), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    slices = kept(sliced(vectors, dims, block_dims))
    for _ in range(rounds):
        assigned = nearest(partial_distances(slices, centroids, block_dims))
        centroids = updated(slices, assigned, centroids, block_dims)
    assigned = nearest(partial_distances(slices, centroids, block_dims))
    ids = slices.where("block = 0").select("chunk", "ids")
    rows = ids.join(assigned, "chunk").select(F.explode(F.arrays_zip("ids", "clusters", "distances")).alias("v"))
    found = rows.select(
        F.col("v.ids").alias(vec_id), F.col("v.clusters").alias("cluster"), F.col("v.distances").alias("distance")
    )
    return found, centroids


def with_summary(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with each cluster's and all clusters' summed distances and the hash of the cluster's centroid."""
    spark = found.sparkSession
    found = kept(found)
    # One row for each cluster.
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(sums.values())
    rows = []
    for number, centroid in enumerate(centroids.tolist()):
        digest = hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
        rows.append((number, sums.get(number, 0), total, digest))
    schema = "__c int, cluster_inertia long, inertia long, centroid_sha256 string"
    about = F.broadcast(spark.createDataFrame(rows, schema))
    return found.join(about, F.col("cluster") == F.col("__c")).drop("__c")
