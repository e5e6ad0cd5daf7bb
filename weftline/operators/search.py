"""Exact and vector search, previews, and consolidation of names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.tables import written


def exact(docs: DataFrame, column: str, literal: str | None = None, regex: str | None = None) -> DataFrame:
    """Rows that hold a literal, or match a regular expression."""
    return docs.where(F.contains(F.col(column), F.lit(literal)) if regex is None else F.col(column).rlike(regex))


def top(hits: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best rows by score, ties by key."""
    return hits.orderBy(F.col(score).desc(), F.col(key)).limit(k)


def cosine_to(vectors: DataFrame, vector: str, query: list[float]) -> DataFrame:
    """Rows with `score`, the cosine to a query vector; null for zero vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot(F.col(vector), F.col(vector))) * F.sqrt(dot(q, q))
    return vectors.withColumn("score", F.when(size > 0, dot(F.col(vector), q) / size))


def _blocks(vectors: DataFrame, key: str, vector: str, rows: int) -> DataFrame:
    """Unit vectors of one length in blocks: (width, ids, units), the units as bytes of doubles. Vectors that are null, empty, zero or hold null or non-finite components are left out."""
    kind = dict(vectors.dtypes)[key]
    fine = f"`{vector}` is not null and size(`{vector}`) > 0 and forall(`{vector}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(`{vector}`, x -> x <> 0)"
    kept = vectors.where(fine).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def block(width: int, ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), pa.array([np.concatenate(parts).tobytes()], pa.binary())], ["width", "ids", "units"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            n = pc.list_value_length(batch["v"]).to_numpy(zero_copy_only=False)
            for width in np.unique(n).tolist():
                own = batch.filter(pa.array(n == width))
                x = own["v"].flatten().to_numpy().reshape(-1, width)
                x = x / np.abs(x).max(axis=1, keepdims=True)  # squares stay finite
                ids, parts = held.setdefault(width, ([], []))
                ids.append(own["id"])
                parts.append(x / np.linalg.norm(x, axis=1, keepdims=True))
                if sum(map(len, ids)) >= rows:
                    yield block(width, *held.pop(width))
        for width, (ids, parts) in held.items():
            yield block(width, ids, parts)

    return kept.mapInArrow(packed, f"width int, ids array<{kind}>, units binary")


def top_per_query(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, *, rows: int = 8192, asked: int = 1024) -> DataFrame:
    """(query, hit, score, rank): for each query the k rows with the highest cosine, equal ones by key; a query may find itself.

    Scores are rounded to 9 places before they are ranked, so that equal vectors tie. Vectors without a direction are
    neither queries nor hits, and only vectors of one length are compared. Queries with equal keys are asked as one.

    Every block of rows meets every block of queries as one product; a pair of blocks sends k hits for each query, and
    Spark cuts these to k again in each task before the shuffle by query.
    """
    kind = dict(vectors.dtypes)[key]
    asks = written(_blocks(queries, key, vector, asked).select(F.monotonically_increasing_id().alias("ask"), "width", F.col("ids").alias("asked"), F.col("units").alias("ask_units")))
    found = written(_blocks(vectors, key, vector, rows))
    pairs = found.join(asks, "width")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width, ids, asked_ids = batch["width"][i].as_py(), batch["ids"][i].values, batch["asked"][i].values
                x, q = (np.frombuffer(batch[c][i].as_py()).reshape(-1, width) for c in ("units", "ask_units"))
                by_id = pc.array_sort_indices(ids).to_numpy()  # equal scores go by id
                ids, x = ids.take(pa.array(by_id)), x[by_id]
                for at in range(0, len(q), 256):
                    score = np.round(q[at : at + 256] @ x.T, 9)
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    n = best.shape[1]
                    yield pa.RecordBatch.from_arrays([asked_ids.slice(at, len(score)).take(pa.array(np.repeat(np.arange(len(score)), n))), ids.take(pa.array(best.ravel())), pa.array(np.take_along_axis(score, best, 1).ravel())], ["query", "hit", "score"])

    hits = pairs.select("width", "ids", "units", "asked", "ask_units").mapInArrow(scored, f"query {kind}, hit {kind}, score double")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "hit")))
    return ranked.where(F.col("rank") <= k)


def previews(docs: DataFrame, key: str, body: str, n: int) -> DataFrame:
    return docs.select(key, F.substring(body, 1, n).alias("preview"))


def full(ids: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The whole rows of chosen ids."""
    return docs.join(ids.select(key), key, "left_semi")


def consolidated(rows: DataFrame, name: str) -> DataFrame:
    """(canonical, n_variants, n): names that differ by case or white space as one; the canonical one is the smallest."""
    normal = F.lower(F.regexp_replace(F.col(name), r"^\s+|\s+$", ""))
    by_name = rows.groupBy(normal.alias("normal"), name).agg(F.count(F.lit(1)).alias("n"))
    return by_name.groupBy("normal").agg(F.min(name).alias("canonical"), F.count(F.lit(1)).alias("n_variants"), F.sum("n").alias("n")).drop("normal")


def near_names(names: DataFrame, name: str, distance: int = 1, least: int = 4) -> DataFrame:
    """(a, b), a < b: different names within an edit distance; names of under `least` characters, or with other digits, are never near.

    Names that are near share a string that is left of each after at most `distance` deletions, so only names that share
    one are compared. A string of n characters is left of no more names than there are letters to put at n + 1 places.
    """
    drop = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    left = last = F.array(F.col(name))
    for _ in range(distance):
        last = F.array_distinct(F.flatten(F.transform(last, drop)))
        left = F.array_union(left, last)
    rows = names.select(name).distinct().where(F.length(name) >= least)
    rows = written(rows.select(F.col(name).alias("a"), F.regexp_replace(name, "[^0-9]", "").alias("digits"), F.explode(left).alias("left")))
    both = rows.join(rows.withColumnRenamed("a", "b"), ["digits", "left"]).where("a < b").select("a", "b").distinct()
    return both.where(F.levenshtein("a", "b", distance) >= 0)


def spelled_alike(rows: DataFrame, name: str, distance: int = 1, least: int = 4) -> DataFrame:
    """(name, canonical, n): each name without case and outer white space, the spelling that it stands for, and its rows.

    A name goes to the most frequent name near it that is more frequent than itself (of equal ones the smaller), and on
    from there, so a rare misspelling of a misspelling ends at the common name; pointers double, so a path of n names
    takes log2(n) rounds. Null and empty names stand for themselves.
    """
    normal = F.lower(F.regexp_replace(F.col(name), r"^\s+|\s+$", ""))
    counts = written(rows.groupBy(normal.alias("name")).agg(F.count(F.lit(1)).alias("n")))
    pairs = near_names(counts.where("name is not null"), "name", distance, least)
    ways = pairs.union(pairs.select("b", "a"))
    rows_of = lambda end: counts.select(F.col("name").alias(end), F.col("n").alias(f"{end}_n"))
    steps = ways.join(rows_of("a"), "a").join(rows_of("b"), "b").where("b_n > a_n or (b_n = a_n and b < a)")
    up = steps.groupBy("a").agg(F.min_by("b", F.struct(-F.col("b_n"), "b")).alias("to"))
    found = written(counts.select("name", "n").join(up.withColumnRenamed("a", "name"), "name", "left").select("name", F.coalesce("to", "name").alias("canonical"), "n"))
    while True:
        nexts = found.select(F.col("name").alias("canonical"), F.col("canonical").alias("__next"))
        after = written(found.join(nexts, "canonical", "left").select("name", F.coalesce("__next", "canonical").alias("canonical"), "n", (~F.col("__next").eqNullSafe(F.col("canonical"))).alias("moved")))
        found = after.drop("moved")
        if after.where("moved and name is not null").isEmpty():
            return found.select("name", "canonical", "n")


def first_layer(layers: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, layer, value): the first of several layers that has a key."""
    rows = [x.select(key, F.lit(i).alias("layer"), F.col(value).alias("value")) for i, x in enumerate(layers)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy(key).agg(F.min(F.struct("layer", "value")).alias("f")).select(key, "f.layer", "f.value")


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one column with `side`: both, left or right."""
    both = left.intersect(right).withColumn("side", F.lit("both"))
    return both.unionByName(left.exceptAll(right).distinct().withColumn("side", F.lit("left"))).unionByName(right.exceptAll(left).distinct().withColumn("side", F.lit("right")))
