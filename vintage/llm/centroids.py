"""Centroid clustering by Lloyd's rounds, sharded by dimension.

Vectors are cut into column blocks of ``SLICE`` dimensions. A shard row holds one column block of up to
``ROWS`` vectors as a matrix of small integers, so neither a task nor a row ever needs a whole vector:

1. a task computes, from a shard row and its slice of the centroids alone, the exact partial squared
   distances of its vectors to every centroid;
2. the partial distances of one block of vectors are added by key and the nearest centroid is taken;
3. each shard adds up its own columns by cluster and gets its own slice of the next centroids.

Components are integers, floor(scale * x), and all sums are of 64 bits, so results are exact whatever the
order. Shard rows are stored once, bucketed by block of vectors: assignments (a byte or so a vector) move
to them, vectors don't move. What reaches the driver are the centroids, their sums and their number of
vectors: ``k`` times the dimensions, however many vectors there are.

Kept are vectors of exactly ``dims`` components, none null or non-finite; other rows have no result. Rows
that repeat a vec_id are vectors of their own. The first centroids are those with the smallest hashes of
their ids; equal hashes (one id) are ordered by components, and vectors without an id come last. With fewer
kept vectors than ``k`` there are as many centroids as vectors. Distances must fit in 64 bits: a component
of 2**27 or more after scaling is an error. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import as_long, settle, shared_dir, whole_groups

K = 16
TURNS = 3
DIMS = 64
SCALE = 64
SLICE = 16  # dimensions of a shard
ROWS = 1024  # vectors of a block
LIMIT = 1 << 27


def kept_vectors(rows: DataFrame, dims: int = DIMS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce((F.size(vector) == dims) & finite, F.lit(False))).select(F.col(id_col).alias("vec_id"), vector.alias("vec"))


def scaled(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as integers."""
    x = np.floor(vectors * float(scale))
    if x.size and np.abs(x).max() >= LIMIT:
        raise ValueError(f"a component of {np.abs(x).max():g} after scaling: squared distances may not fit in 64 bits")
    return x.astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them all."""
    kinds = [np.int8, np.int16, np.int32, np.int64]
    low, high = (x.min(), x.max()) if x.size else (0, 0)
    return x.astype(next(t for t in kinds if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def widened(raw: bytes, rows: int, columns: int) -> np.ndarray:
    """The matrix that ``narrow`` made bytes of."""
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[len(raw) // (rows * columns)]
    return np.frombuffer(raw, kind).reshape(rows, columns).astype(np.int64)


def shards(vectors: DataFrame, dims: int, scale: float, width: int = SLICE) -> DataFrame:
    """The stored table of block, shard, n (vectors), ids (in the first shard only) and data, bucketed by
    block."""
    kind = vectors.schema["vec_id"].dataType

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = scaled(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dims), scale)
                slices = [narrow(np.ascontiguousarray(x[:, at : at + width])).tobytes() for at in range(0, dims, width)]
                ids = pa.array([part.column(0).to_pylist(), *[None] * (len(slices) - 1)], pa.list_(part.column(0).type))
                n = len(slices)
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([part.num_rows] * n, pa.int32()), ids, pa.array(slices, pa.binary())], ["block", "shard", "n", "ids", "data"])
                block += 1

    spark = vectors.sparkSession
    made = settle(vectors.mapInArrow(run, f"block long, shard int, n int, ids array<{kind.simpleString()}>, data binary"), "lloyd-made")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"lloyd_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    made.repartition(parts, "block").write.bucketBy(parts, "block").sortBy("block", "shard").option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def first_centroids(vectors: DataFrame, k: int, scale: float) -> np.ndarray:
    """The scaled vectors with the k smallest hashes of ``1:<vec_id>``, in that order."""
    hashed = vectors.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "vec")
    top = hashed.orderBy(F.col("h").asc_nulls_last(), "vec").limit(k).collect()
    return scaled(np.array([r.vec for r in top], float), scale)


def partial_distances(table: DataFrame, centroids: np.ndarray, width: int = SLICE) -> DataFrame:
    """block, n, part: squared distances over some of the columns, to every centroid. Shards of one block
    that follow each other are added before they leave the task."""
    told = table.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = told.value
        block, n, total = None, 0, None
        for batch in batches:
            for b, shard, m, data in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                own = c[:, shard * width : (shard + 1) * width]
                x = widened(data, m, own.shape[1])
                part = np.zeros((m, len(c)), np.int64)
                for j in range(own.shape[1]):
                    part += (x[:, j, None] - own[None, :, j]) ** 2
                if b != block:
                    if block is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([n], pa.int32()), pa.array([narrow(total).tobytes()], pa.binary())], ["block", "n", "part"])
                    block, n, total = b, m, part
                else:
                    total += part
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([n], pa.int32()), pa.array([narrow(total).tobytes()], pa.binary())], ["block", "n", "part"])

    return table.select("block", "shard", "n", "data").mapInArrow(run, "block long, n int, part binary")


def nearest(parts: DataFrame, k: int) -> DataFrame:
    """block, cluster and distance (of each vector, as bytes): partial distances added, and the nearest
    centroid, of equally near ones that with the smaller number. A settled table."""

    def run(batches):
        for batch, bounds in whole_groups(batches):
            blocks, n, raw = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                total = sum(widened(raw[i], n[i], k) for i in range(lo, hi))
                best = total.argmin(1)
                out.append((blocks[lo], best.astype(np.int32).tobytes(), total[np.arange(len(best)), best].tobytes()))
            block, cluster, distance = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(cluster, pa.binary()), pa.array(distance, pa.binary())], ["block", "cluster", "distance"])

    dealt = parts.repartition("block").sortWithinPartitions("block")
    return settle(dealt.mapInArrow(run, "block long, cluster binary, distance binary"), "lloyd-nearest")


def updated(table: DataFrame, assigned: DataFrame, centroids: np.ndarray, width: int = SLICE) -> np.ndarray:
    """The next centroids: each shard's sums of its own columns by cluster, floor-divided by the cluster's
    number of vectors. A centroid without vectors stays."""
    k, dims = centroids.shape

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, n, data, cluster in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                of = np.frombuffer(cluster, np.int32)
                x = widened(data, n, min(width, dims - shard * width))
                if shard not in sums:
                    sums[shard], counts[shard] = np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)
                order = np.argsort(of, kind="stable")
                heads = np.flatnonzero(np.diff(of[order], prepend=-1))
                sums[shard][of[order][heads]] += np.add.reduceat(x[order], heads)
                counts[shard] += np.bincount(of, minlength=k)
        for shard, total in sums.items():
            some = np.flatnonzero(counts[shard])
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(some), pa.int32()), pa.array(some.astype(np.int32)), as_long(counts[shard][some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["shard", "cluster", "n", "sums"])

    own = table.select("block", "shard", "n", "data").join(assigned.select("block", "cluster"), "block").select("shard", "n", "data", "cluster")
    added = own.mapInArrow(run, "shard int, cluster int, n long, sums array<long>").groupBy("shard", "cluster")
    total = added.agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(min(width, dims))])
    mean = lambda s: F.when(F.col(s).isNotNull(), F.expr(f"({s} - pmod({s}, n)) div n"))
    slices = total.select("shard", "cluster", F.array_compact(F.array(*[mean(f"s{j}") for j in range(min(width, dims))])).alias("slice"))
    out = centroids.copy()
    for r in slices.collect():  # k rows for each shard
        out[r.cluster, r.shard * width : r.shard * width + len(r.slice)] = r.slice
    return out


def inertias(assigned: DataFrame) -> dict[int, int]:
    """Sum of the distances of each cluster that has vectors."""

    def run(batches):
        for batch in batches:
            of = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
            distance = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            if len(of):
                order = np.argsort(of, kind="stable")
                heads = np.flatnonzero(np.diff(of[order], prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(of[order][heads]), pa.array(np.add.reduceat(distance[order], heads))], ["cluster", "distance"])

    sums = assigned.select("cluster", "distance").mapInArrow(run, "cluster int, distance long").groupBy("cluster").agg(F.sum("distance").alias("distance"))
    return {r.cluster: r.distance for r in sums.collect()}  # k rows


def clustered(rows: DataFrame, k: int = K, turns: int = TURNS, dims: int = DIMS, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector; the final
    centroids)."""
    vectors = kept_vectors(rows, dims, id_col, vector_col)
    spark, kind = rows.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(vectors, k, scale)
    if not len(centroids):
        return spark.createDataFrame([], schema), np.zeros((0, dims), np.int64)
    table = shards(vectors, dims, scale)
    for _ in range(turns):
        assigned = nearest(partial_distances(table, centroids), len(centroids))
        centroids = updated(table, assigned, centroids)
    assigned = nearest(partial_distances(table, centroids), len(centroids))
    own = inertias(assigned)
    of_cluster = np.array([own.get(i, 0) for i in range(len(centroids))], np.int64)
    total = np.int64(sum(own.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches):
        for batch in batches:
            of = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32)
            distance = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            digest = pa.DictionaryArray.from_arrays(pa.array(of), pa.array(digests)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).flatten(), pa.array(of), pa.array(distance), pa.array(of_cluster[of]), pa.array(np.full(len(of), total)), digest], ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    ids = table.filter("shard = 0").select("block", "ids").join(assigned, "block").select("ids", "cluster", "distance")
    return ids.mapInArrow(run, schema), centroids
