"""Near-duplicate vectors by an inverted multi-index, verified by exact cosines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.graph import components
from weftline.llm.shared import saved

#: Vectors that the codebooks are fitted on at most; they come to the driver.
SAMPLE = 8192
#: Vectors that a cell of one label shall hold on average.
CELL = 64
#: Numbers of one array while cells are ranked.
ARRAY = 1 << 22
#: Vectors of a cell, and visitors of a cell, that one task compares at a time.
MEMBERS, VISITORS = 2048, 8192


@dataclass(frozen=True)
class MultiIndex:
    """Two codebooks, for the first and the second half of unit vectors; a cell is a pair of codes.

    visits is the number of cells that a vector looks into, in the order of their distance from it.
    """

    first: np.ndarray
    second: np.ndarray
    visits: int = 1

    @property
    def width(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        near = lambda x, codes: (codes**2).sum(1) - 2 * x @ codes.T  # noqa: E731  less |x|^2, which is the same for all codes
        return near(unit[:, :half], self.first), near(unit[:, half:], self.second)

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        """The `visits` nearest cells of each vector, nearest first.

        The multi-sequence traversal takes the pair of ranks (r, s) after all pairs below it, so the first n cells
        are among the pairs with (r + 1) * (s + 1) <= n: these are compared for some vectors at once.
        """
        k, l = len(self.first), len(self.second)
        n = min(self.visits, k * l)
        ranks = np.array([(r, s) for r in range(min(n, k)) for s in range(min(n // (r + 1), l))])
        found, step = np.empty((len(unit), n), np.int32), max(1, ARRAY // max(len(ranks), k, l))
        for at in range(0, len(unit), step):
            one, two = self.distances(unit[at : at + step])
            a, b = np.argsort(one, 1, kind="stable")[:, ranks[:, 0]], np.argsort(two, 1, kind="stable")[:, ranks[:, 1]]
            total = np.take_along_axis(one, a, 1) + np.take_along_axis(two, b, 1)
            order = np.argsort(total, 1, kind="stable")[:, :n]
            found[at : at + step] = np.take_along_axis(a * l + b, order, 1)
        return found

    def rank(self, unit: np.ndarray, other: np.ndarray) -> np.ndarray:
        """At which place the traversal from each vector comes to the cell of the other one."""
        (one, two), (o1, o2) = self.distances(unit), self.distances(other)
        rows = np.arange(len(unit))
        at = one[rows, o1.argmin(1)] + two[rows, o2.argmin(1)]
        return np.array([np.searchsorted(np.sort(t), x - o).sum() for o, t, x in zip(one, two, at, strict=True)])


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    codes = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([((codes**2).sum(1) - 2 * x[i : i + 512] @ codes.T).argmin(1) for i in range(0, len(x), 512)])
        sums = np.zeros_like(codes)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=k)
        codes[n > 0] = sums[n > 0] / n[n > 0, None]
    return codes


def fit_index(sample: np.ndarray, codes: int, threshold: float, recall: float, seed: int = 7) -> MultiIndex:
    """Codebooks by k-means on the sample, and the visits that find the target share of partners.

    For that, each of up to 1024 sampled vectors gets two partners at the threshold's angle, the farthest that may
    link: one in a random direction, one towards another sampled vector, as vectors that fill few dimensions have
    them. visits is where the traversal from one has come to the other's cell for the target share of either kind.
    """
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    half, k = unit.shape[1] // 2, min(codes, len(unit))
    index = MultiIndex(_codebook(unit[:, :half], k, rng), _codebook(unit[:, half:], k, rng))
    some = unit[rng.choice(len(unit), min(1024, len(unit)), replace=False)]
    visits = 1
    for aside in (rng.normal(size=some.shape), unit[rng.integers(0, len(unit), len(some))]):
        aside = aside - (aside * some).sum(1, keepdims=True) * some
        norm = np.linalg.norm(aside, axis=1, keepdims=True)
        partner = threshold * some + np.sqrt(1 - threshold**2) * np.divide(aside, norm, out=np.zeros_like(aside), where=norm > 1e-9)
        ranks = np.concatenate([index.rank(some[i : i + 16], partner[i : i + 16]) for i in range(0, len(some), 16)])
        visits = max(visits, int(np.quantile(ranks, recall, method="higher")) + 1)
    return MultiIndex(index.first, index.second, visits)


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """Vectors kept as bytes as rows of doubles, shorter ones with zeros behind."""
    found = np.zeros((len(column), width))
    for i, raw in enumerate(column):
        x = np.frombuffer(raw.as_py(), dtype)
        found[i, : len(x)] = x
    return found


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare_cell(table: pa.Table, dtype: str, threshold: float) -> pa.Table:
    """Links between the visitors and the members of one cell: rows (node, other, links).

    A row with `other` is a link that joins components; a spanning forest is enough for these. A row without it adds
    `links` to a node. A visitor counts each partner; a partner counts the visitor only if it doesn't visit the
    visitor's cell itself, so that a pair that is found from both sides counts once on either side.
    """
    width = max(len(raw.as_py()) for raw in table["vec"]) // np.dtype(dtype).itemsize
    role = table["member"].to_numpy()
    parts = []
    for is_member in (False, True):
        rows = table.filter(pa.array(role == is_member))
        parts.append((rows["node"].to_numpy(), rows["copies"].to_numpy(), rows["own"].to_numpy(), rows["visited"].to_pylist(), _unit(_matrix(rows["vec"].combine_chunks(), dtype, width))))
    (q, q_copies, q_own, _, left), (m, m_copies, _, m_visited, right) = parts
    seen = [frozenset(v or ()) for v in m_visited]
    q_links, m_links = np.zeros(len(q), np.int64), np.zeros(len(m), np.int64)
    m_label, q_label = np.arange(len(m)), np.full(len(q), len(m))
    blocks = []
    for at in range(0, len(q), 512):
        hit = (left[at : at + 512] @ right.T >= threshold) & (q[at : at + 512, None] != m[None, :])
        if hit.any():
            rows, cols = np.nonzero(hit)
            q_links[at : at + 512] += (hit * m_copies[None, :]).sum(1)
            back = np.fromiter((q_own[at + r] not in seen[c] for r, c in zip(rows, cols, strict=True)), bool, len(rows))
            np.add.at(m_links, cols[back], q_copies[at + rows[back]])
            blocks.append((at + rows, cols))
    out: list[tuple[np.ndarray, ...]] = []
    if blocks:
        rows, cols = (np.concatenate(x) for x in zip(*blocks, strict=True))
        while True:  # the smallest member that links lead to
            before = m_label.copy()
            np.minimum.at(q_label, rows, m_label[cols])
            np.minimum.at(m_label, cols, q_label[rows])
            if (before == m_label).all():
                break
        linked = q_label < len(m)
        out += [(q[linked], m[q_label[linked]], np.zeros(linked.sum(), np.int64)), (m[np.unique(cols)], m[m_label[np.unique(cols)]], np.zeros(len(np.unique(cols)), np.int64))]
        for node, n in ((q, q_links), (m, m_links)):
            out.append((node[n > 0], np.full((n > 0).sum(), -1), n[n > 0]))
    node, other, links = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
    keep = (node != other) | (links > 0)
    return pa.table({"node": node[keep], "other": other[keep], "links": links[keep]}, schema=pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())]))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.99) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id and kept.

    Vectors link if their labels and lengths are equal, the label is not null and their cosine in double precision is
    at least the threshold. Vectors that are null, empty, zero or hold null, NaN or infinite components link with
    nothing. n_links counts the other vectors linked directly, copies included; component_id is the smallest vec_id
    that links lead to; kept says that this is the vector's own. Rows with a null vec_id take part; their component
    is the smallest one that is not null. Other columns are not read; an empty table gives no rows.

    Equal vectors of a label are compared once, as a class with a number of copies. An index of two codebooks is
    fitted on at most SAMPLE classes; every class goes into the cell of its two codes and looks into its nearest
    cells until the target recall. Large cells are dealt out in blocks, and a cell emits counts and a spanning
    forest, never all pairs.
    """
    kind = dict(vectors.dtypes)
    dtype = "f8" if kind["embedding"] == "array<double>" else "f4"
    id_type = kind["vec_id"]
    fine = "embedding is not null and size(embedding) > 0 and label is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = vectors.select("vec_id", "label", "embedding", F.expr(fine).alias("fine"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec = [(np.asarray(x.as_py(), dtype) + 0.0).tobytes() if ok else None for x, ok in zip(b["embedding"], b["fine"].to_pylist(), strict=True)]  # + 0.0: -0 becomes 0
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array(vec, pa.binary())], ["vec_id", "label", "vec"])

    rows = saved(rows.mapInArrow(packed, f"vec_id {id_type}, label {kind['label']}, vec binary").withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = rows.where("vec is not null").groupBy("label", "vec").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"))
    classes = saved(classes, "vector-classes")
    of_label = classes.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max(F.octet_length("vec")).alias("width"))
    n, squares, width = of_label.agg(F.sum("n"), F.sum(F.col("n") * F.col("n")), F.max("width")).first()
    if n:
        width = width // np.dtype(dtype).itemsize
        sample = classes.select("vec", F.xxhash64("vec").alias("h")).orderBy("h", "vec").limit(SAMPLE).select("vec").toArrow()["vec"].combine_chunks()
        # by the label size that a vector meets on average: large labels decide, however many small ones there are
        codes = int(max(1, np.sqrt(squares / n / CELL)))
        index = fit_index(_unit(_matrix(sample, dtype, max(2, width))), codes, threshold, recall)
        links = _links(classes, index, kind["label"], dtype, threshold)
    else:
        links = vectors.sparkSession.createDataFrame([], "node long, other long, links long")
    links = saved(links, "vector-links")

    comps = components(links.where("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = links.where("other < 0").groupBy("node").agg(F.sum("links").alias("links"))
    of_class = classes.join(counts, "node", "left").join(comps, "node", "left")
    of_class = of_class.select(F.col("label").alias("c_label"), F.col("vec").alias("c_vec"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("group"))
    rows = rows.join(of_class, (F.col("label") == F.col("c_label")) & (F.col("vec") == F.col("c_vec")), "left")
    rows = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("group", F.col("row")).alias("group"))
    rows = saved(rows, "vector-rows")
    first = rows.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    return rows.join(first, "group").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(classes: DataFrame, index: MultiIndex, label_type: str, dtype: str, threshold: float) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(index)  # two codebooks of at most SAMPLE half vectors

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cells = shared.value.nearest(_unit(_matrix(b["vec"], dtype, shared.value.width)))
            visited = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32), cells.ravel())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("node", "label", "vec", "copies")), pa.array(cells[:, 0], pa.int32()), visited], ["node", "label", "vec", "copies", "own", "visited"])

    at = classes.mapInArrow(placed, f"node long, label {label_type}, vec binary, copies long, own int, visited array<int>")
    at = saved(at.withColumn("dim", F.octet_length("vec")), "vector-cells")
    key = ["label", "dim", "cell"]
    inside = at.groupBy("label", "dim", F.col("own").alias("cell")).agg(F.count(F.lit(1)).alias("m"))
    visits = at.select("label", "dim", F.explode("visited").alias("cell")).groupBy(*key).agg(F.count(F.lit(1)).alias("q"))
    # only large cells are dealt out in blocks; there are at most as many as the rows divided by MEMBERS
    large = inside.join(visits, key, "left").where(f"m > {MEMBERS} or q > {VISITORS}").select(*key, F.expr(f"cast((m - 1) div {MEMBERS} + 1 as int)").alias("ms"), F.expr(f"cast((coalesce(q, 1) - 1) div {VISITORS} + 1 as int)").alias("qs"))
    carried = ["node", "copies", "own", "visited", "vec"]
    one = lambda c: F.coalesce(c, F.lit(1))
    part = lambda c: F.pmod(F.xxhash64("node"), one(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    members = at.withColumn("cell", F.col("own")).join(large, key, "left").withColumn("mb", part("ms")).withColumn("qb", every("qs")).withColumn("member", F.lit(True))
    # a visitor's own list of cells is not needed, and only cells with members are worth a visit
    visitors = at.withColumn("cell", F.explode("visited")).withColumn("visited", F.lit(None).cast("array<int>")).join(inside.select(*key), key, "left_semi")
    visitors = visitors.join(large, key, "left").withColumn("qb", part("qs")).withColumn("mb", every("ms")).withColumn("member", F.lit(False))
    columns = [*key, "mb", "qb", "member", *carried]
    return members.select(*columns).union(visitors.select(*columns)).groupBy(*key, "mb", "qb").applyInArrow(lambda table: compare_cell(table, dtype, threshold), "node long, other long, links long")
