"""Exact integer k-means by filtering over kd-trees that each task builds of its own vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weftline.llm.shared import id_key, saved

#: Components, centroids and rounds of the query.
WIDTH, K, ROUNDS, SCALE = 64, 40, 5, 256
#: Vectors of one tree, and of a leaf at most.
BLOCK, LEAF = 8192, 64
#: Components up to which products of vectors are exact in doubles, and beyond which squared distances leave 64 bits.
EXACT, MOST = 1 << 22, 1 << 27


def spans(n: int) -> list[tuple[int, int]]:
    """(start, end) of the nodes of a tree over n vectors, the root first: node i has the halves 2i+1 and 2i+2 until they fit a leaf."""
    out, size = [(0, n)], n
    while size > LEAF:
        level = out[len(out) // 2 :]
        for a, b in level:
            out += [(a, (a + b) // 2), ((a + b) // 2, b)]
        size = (size + 1) // 2
    return out


@dataclass(frozen=True)
class Tree:
    """Vectors in the order of a kd-tree; for each node its count (by spans), the exact sum of its vectors and their box."""

    vectors: np.ndarray
    sums: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def order(x: np.ndarray) -> np.ndarray:
        """The order in which every node's vectors stand together: halves along the node's widest component."""
        order, nodes = np.arange(len(x)), spans(len(x))
        for a, b in nodes[: len(nodes) // 2]:
            own = x[order[a:b]]
            widest = int((own.max(0) - own.min(0)).argmax())
            order[a:b] = order[a:b][np.argpartition(own[:, widest], (b - a) // 2, kind="introselect")]
        return order

    @classmethod
    def of(cls, x: np.ndarray) -> Tree:
        """The tree of vectors that stand in its order; inner nodes take sums and boxes from their halves."""
        nodes = spans(len(x))
        sums, low, high = (np.empty((len(nodes), x.shape[1]), np.int64) for _ in range(3))
        for i in range(len(nodes) - 1, -1, -1):
            a, b = nodes[i]
            if 2 * i + 2 < len(nodes):
                left, right = 2 * i + 1, 2 * i + 2
                sums[i], low[i], high[i] = sums[left] + sums[right], np.minimum(low[left], low[right]), np.maximum(high[left], high[right])
            else:
                sums[i], low[i], high[i] = x[a:b].sum(0), x[a:b].min(0), x[a:b].max(0)
        return cls(x, sums, low, high)

    def filtered(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(node, start, end, centroids that are left): nodes that one centroid owns, and leaves with those not ruled out.

        A centroid is ruled out where even the corner of the box that lies farthest its way is strictly nearer to the
        centroid that is nearest to the box's middle; so ties are left to the leaves.
        """
        nodes = spans(len(self.vectors))
        stack = [(0, np.arange(len(centroids)))]
        while stack:
            i, left = stack.pop()
            a, b = nodes[i]
            if len(left) > 1:
                c = centroids[left]
                near = int(((2 * c - self.low[i] - self.high[i]) ** 2).sum(1).argmin())
                aside = c - c[near]
                corner = np.where(aside > 0, self.high[i], self.low[i])
                left = left[(aside * (c + c[near] - 2 * corner)).sum(1) <= 0]
            if len(left) == 1 or 2 * i + 2 >= len(nodes):
                yield i, a, b, left
            else:
                stack += [(2 * i + 2, left), (2 * i + 1, left)]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest centroid, squared distance) of each vector, exactly; of equal ones the first."""
    largest = max(np.abs(x).max(), np.abs(centroids).max())
    if largest <= EXACT:  # whole numbers below 2^53: doubles hold every step
        x, c = x.astype(float), centroids.astype(float)
        d = (x**2).sum(1)[:, None] - 2 * (x @ c.T) + (c**2).sum(1)[None, :]
    else:
        d = np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)
    place = d.argmin(1)
    return place, d[np.arange(len(x)), place].astype(np.int64)


def _trees(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """One row for each tree: the ids of its vectors, the vectors, and the sums and boxes of its nodes, as bytes."""
    kind = dict(vectors.dtypes)["vec_id"]

    def grown(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts)
        if np.abs(x).max() > MOST:
            raise ValueError(f"a component is beyond {MOST / scale:g}: its distances don't fit 64 bits")
        order = Tree.order(x)
        tree = Tree.of(x[order])
        small = np.int32
        columns = [pa.array([pa.concat_arrays(ids).take(pa.array(order)).to_pylist()], pa.list_(ids[0].type)), *(pa.array([v.astype(t).tobytes()], pa.binary()) for v, t in ((tree.vectors, small), (tree.sums, np.int64), (tree.low, small), (tree.high, small)))]
        return pa.RecordBatch.from_arrays(columns, ["ids", "vectors", "sums", "low", "high"])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                flat = some["embedding"].flatten().to_numpy(zero_copy_only=False).astype(float)
                scaled = np.floor(scale * flat)
                # beyond 64 bits a cast has no defined result; clipped values are refused below
                parts.append(np.clip(scaled, -(2.0**60), 2.0**60).astype(np.int64).reshape(some.num_rows, width))
                ids.append(some["vec_id"])
                n += some.num_rows
                if n >= BLOCK:
                    yield grown(ids, parts)
                    ids, parts, n = [], [], 0
        if n:
            yield grown(ids, parts)

    return vectors.select("vec_id", "embedding").mapInArrow(of_task, f"ids array<{kind}>, vectors binary, sums binary, low binary, high binary")


def _read(batch: pa.RecordBatch, i: int, width: int) -> Tree:
    at = lambda name, kind: np.frombuffer(batch[name][i].as_py(), kind).reshape(-1, width).astype(np.int64)
    return Tree(at("vectors", np.int32), at("sums", np.int64), at("low", np.int32), at("high", np.int32))


def _sums(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums) of the vectors of each centroid, added up in each task first."""
    width = centroids.shape[1]
    shared = trees.sparkSession.sparkContext.broadcast(centroids)  # k rows

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                tree = _read(batch, i, width)
                for node, a, b, left in tree.filtered(c):
                    if len(left) == 1:
                        n[left[0]] += b - a
                        total[left[0]] += tree.sums[node]
                    else:
                        own = left[nearest(tree.vectors[a:b], c[left])[0]]
                        n += np.bincount(own, minlength=len(c))
                        np.add.at(total, own, tree.vectors[a:b])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    each = trees.drop("ids").mapInArrow(summed, "cluster int, n long, sums array<long>")
    return each.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))


def _assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    width = centroids.shape[1]
    shared = trees.sparkSession.sparkContext.broadcast(centroids)
    kind = dict(trees.dtypes)["ids"].removeprefix("array<").removesuffix(">")

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                tree = _read(batch, i, width)
                own, far = np.empty(len(tree.vectors), np.int32), np.empty(len(tree.vectors), np.int64)
                for _, a, b, left in tree.filtered(c):
                    place, far[a:b] = nearest(tree.vectors[a:b], c[left])
                    own[a:b] = left[place]
                yield pa.RecordBatch.from_arrays([batch["ids"][i].values, pa.array(own), pa.array(far)], ["vec_id", "cluster", "distance"])

    return trees.select("ids", "vectors", "sums", "low", "high").mapInArrow(assigned, f"vec_id {kind}, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, *, width: int = WIDTH, scale: int = SCALE, seed: int = 2) -> DataFrame:
    """One row for each vector that is kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of `width` components, none null, NaN or infinite; each component x becomes floor(scale * x). The
    k kept vectors with the smallest SHA-256 of `seed:vec_id` start as the centroids 0, 1, ...: repeated ids in the
    order of their vectors; a null id counts as empty text. With fewer vectors there are fewer centroids, with none
    there are no rows. A round moves each centroid to the exact floored mean of the vectors nearest to it; one that
    has none stays. Distances are squared, and equal ones go to the smaller number. Repeated rows count each. Other
    columns are not read. A component beyond 2^27 / scale fails, as its distances don't fit 64 bits.

    Each task builds kd-trees of BLOCK of its vectors once, which are written. A round reads them and sends k rows for
    each task: whole nodes add their sums where one centroid is left, leaves add their vectors. Only the k centroids
    reach the driver and the executors.
    """
    fine = f"embedding is not null and size(embedding) = {width} and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    kept = vectors.select("vec_id", "embedding").where(fine)
    spark = vectors.sparkSession
    trees = saved(_trees(kept, width, scale), "kd-trees", wide=True)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), id_key(F.col("vec_id"))), 256)
    starts = kept.orderBy(key, "embedding").limit(k).select(F.transform("embedding", lambda x: F.floor(scale * x.cast("double"))).alias("c")).collect()
    centroids = np.array([r.c for r in starts], np.int64).reshape(len(starts), width)
    if len(starts):
        for _ in range(rounds):
            moved = centroids.copy()
            for r in _sums(trees, centroids).collect():  # k rows
                moved[r.cluster] = [s // r.n for s in r.sums]
            centroids = moved
    rows = saved(_assigned(trees, centroids), "clustered")
    inertia = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    of_cluster = {r.cluster: r.cluster_inertia for r in inertia.collect()}  # k rows
    total = sum(of_cluster.values())
    schema = StructType([StructField("__of", LongType()), StructField("cluster_inertia", LongType()), StructField("inertia", LongType()), StructField("centroid_sha256", StringType())])
    figures = spark.createDataFrame([(i, of_cluster.get(i, 0), total, d) for i, d in digests], schema)
    joined = rows.join(F.broadcast(figures), F.col("cluster") == F.col("__of"))  # k rows
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
