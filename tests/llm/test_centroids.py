"""Filtering over kd-trees against plain k-means in whole numbers."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import centroids


def plain(rows, k, rounds, width, scale=256):
    kept = [(i, [math.floor(scale * float(x)) for x in v], v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[:k]
    c = [v for _, v, _ in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(c)), key=lambda j: (far(v, c[j]), j))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v, _ in kept:
            of[near(v)].append(v)
        c = [[sum(col) // len(of[j]) for col in zip(*of[j])] if of[j] else c[j] for j in range(len(c))]
    own = [(i, j := near(v), far(v, c[j])) for i, v, _ in kept]
    inertia = Counter()
    for _, j, d in own:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], inertia.total(), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in own)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("clash"), "__of": F.lit(1)})


@pytest.mark.parametrize("spread", [1.0, 0.01, 3e4])
def test_against_plain(spark, spread):
    r = random.Random(3)
    rows = [(i, [float(np.float32(r.gauss(0, spread) + (i % 5))) for _ in range(6)]) for i in range(900)]
    rows += [(i, list(rows[i][1])) for i in range(40)] + [(None, rows[0][1]), (None, rows[1][1])]  # copies, null ids
    rows += [(1000 + i, [float(i % 3), 0.0, 0.0, 0.0, 0.0, -0.0]) for i in range(60)]  # ties
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0] * 7), (2004, [None] + [1.0] * 5), (2005, [math.nan] + [1.0] * 5), (2006, [math.inf] + [1.0] * 5)]
    got = centroids.cluster_vectors(frame(spark, rows).repartition(3), 12, 3, width=6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == plain(rows, 12, 3, 6)


def test_fewer_vectors_than_centroids(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.5, 0.25])]
    assert Counter(map(tuple, centroids.cluster_vectors(frame(spark, rows), 40, 5, width=2).collect())) == plain(rows, 40, 5, 2)


def test_nothing_to_cluster(spark):
    assert centroids.cluster_vectors(frame(spark, []), width=2).collect() == []
    assert centroids.cluster_vectors(frame(spark, [(1, None)]), width=2).collect() == []


def test_too_large_fails(spark):
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster_vectors(frame(spark, [(1, [1e30, 0.0])]), width=2).collect()


def test_filtering_prunes_and_stays_exact():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(5000, 3)) * 300 + rng.integers(0, 8, (5000, 1)) * 4000).astype(np.int64)
    x = x[centroids.Tree.order(x)]
    tree, c = centroids.Tree.of(x), x[rng.choice(5000, 30, replace=False)]
    c[1] = c[0]  # equal centroids: the first wins
    place, far = centroids.nearest(x, c)
    seen = compared = 0
    for node, a, b, left in tree.filtered(c):
        seen += b - a
        compared += (b - a) * len(left) if len(left) > 1 else 0
        own, d = centroids.nearest(x[a:b], c[left])
        assert (left[own] == place[a:b]).all() and (d == far[a:b]).all()
        assert (tree.sums[node] == x[a:b].sum(0)).all() and (tree.low[node] == x[a:b].min(0)).all() and (tree.high[node] == x[a:b].max(0)).all()
    assert seen == 5000 and compared < 5000 * 30 / 4
