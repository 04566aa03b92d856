"""Similar vectors: a dense topic, recall of the default settings against brute force."""

import numpy as np

from siftspark.llm import neighbours


def _frame(spark, x):
    return spark.createDataFrame([(i, v.astype("float32").tolist()) for i, v in enumerate(x)], "id long, vector array<float>")


def test_dense_topic(spark):
    """A third of all vectors is nearly equal; the nearest five are found and few pairs are formed."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=32)
    x = np.concatenate([centre + 0.01 * rng.normal(size=(700, 32)), rng.normal(size=(1400, 32))])
    got = neighbours.nearest(_frame(spark, x), 5, dim=32, m=8, min_similarity=0.9, candidates=128, spread=8).toPandas()
    x = x.astype("float32").astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.9}
    found = set(zip(got["id"], got["neighbour"]))
    assert len(want) >= 3500 and len(found & want) >= 0.95 * len(want)
    assert (got.groupby("id").size() <= 5).all() and (got["cosine"] >= 0.9).all()


def test_recall_of_the_defaults(spark):
    rng = np.random.default_rng(6)
    topics = rng.normal(size=(40, 64))
    x = topics[rng.integers(0, 40, 3000)] + 0.7 * rng.normal(size=(3000, 64))
    df = _frame(spark, x)
    true = {(r.id, r.neighbour) for r in neighbours.exact_nearest(df, neighbours.asked, 10, block=700).collect()}
    u = x.astype("float32").astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert true == {(i, int(j)) for i in range(0, 3000, 100) for j in np.argsort(-s[i])[:10]}
    some = {(r.id, r.neighbour) for r in neighbours.nearest(df, 10, queries=neighbours.asked).collect()}
    every = {(r.id, r.neighbour) for r in neighbours.nearest(df, 10).collect() if r.id % 100 == 0}
    assert len(some & true) >= 0.95 * len(true) and len(every & true) >= 0.95 * len(true)


def test_bound_of_the_error():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = neighbours.Index(x, 2000, 8)
    home = index.near(x, 1)[:, 0]
    code, along, size, error = index.encode(x, home)
    s, reach = index.similarity(x[:50], home, along, size, code)
    assert (np.abs(s - x[:50] @ x.T) <= error.astype(float) * reach + 1e-5).all()
