"""An index for labels of very different sizes: the large ones decide how fine it is."""

import numpy as np

from weftline.llm import near_vectors


def test_one_large_label_among_many_small_ones(spark, monkeypatch):
    asked = []
    real = near_vectors.fit_index

    def fitted(sample, codes, *rest):
        asked.append(codes)
        return real(sample, codes, *rest)

    monkeypatch.setattr(near_vectors, "CELL", 16)
    monkeypatch.setattr(near_vectors, "fit_index", fitted)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(800, 16))
    x = np.concatenate([base, base + 0.03 * rng.normal(size=base.shape), rng.normal(size=(400, 16))]).astype("f4")
    label = [0] * 1600 + list(range(1, 401))
    df = spark.createDataFrame([(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r.n_links for r in near_vectors.near_vectors(df).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    same = np.array(label)[:, None] == np.array(label)[None, :]
    want = ((unit @ unit.T >= 0.98) & same & ~np.eye(len(x), dtype=bool)).sum(1)
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum() > 0
    assert asked == [8]  # (1600 * 1600 + 400) / 2000 vectors to meet, 16 to a cell; by the mean label it would be 1


def test_equal_labels_are_as_before(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(near_vectors, "CELL", 4)
    real = near_vectors.fit_index
    monkeypatch.setattr(near_vectors, "fit_index", lambda sample, codes, *rest: asked.append(codes) or real(sample, codes, *rest))
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist(), i % 5) for i in range(500)], "vec_id long, embedding array<double>, label int")
    assert near_vectors.near_vectors(df).count() == 500
    assert asked == [5]
