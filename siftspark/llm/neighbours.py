"""Problem 1: the most similar vectors for every vector.

An inverted file of coarse centroids with product-quantised residuals, asymmetric
distance tables and exact reranking, by cosine.

* Vectors are made unit length. The number of centroids follows the rows (one for 256, at
  most 65,536), and so does the sample on which they and the residual codebooks are fitted
  (16,384 vectors, or eight a centroid, so at most 524,288, chosen by a hash of their ids).
  Centroids are fitted in two levels. Every vector is indexed.
* A residual is the part of a vector across its centroid; the part along it is kept as a
  number. Residuals are coded by direction, with their length beside the code. So the error
  of a similarity is a share of both residuals' lengths, and a dense topic is told apart as
  finely as a thin one. The error itself is kept too; it bounds the similarity from above.
* An entry (id, home centroid, part along it, length, error, ``m`` code bytes) is filed under its ``spread``
  nearest centroids, and a query looks under its ``probes`` nearest ones. Where every vector
  asks, the small entries are copied and a query looks under one centroid only, so each full
  vector is shuffled once. Where few ask, their queries are copied and the entries are not.
* Under a centroid every query builds its distance tables (query part times codebook)
  and sums table entries for each code. A cell larger than ``block`` queries or entries
  is split into a grid of blocks, so a dense topic is spread over tasks. Rows travel in
  packs, one binary per cell and batch, since a row of its own would cost more than an entry.
* The best ``candidates`` of each query by table distance are reranked with the exact
  vectors; each pair is moved and computed once, whichever of the two asked. With
  ``min_similarity`` entries whose upper bound is below it are left out before.

Vectors that are equal number for number are collapsed to one before the search; their
ids are given back at the end, each copy with its ``k`` first other copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftspark.session import checkpoint
from siftspark.sources.tables import table

MAX_TRAIN = 16_384
PER_CENTROID, MAX_CENTROIDS = 256, 65_536
SPREAD, PROBES = 32, 64  # copies of an entry where all ask, of a query where few do
M = 16
BLOCK = 4_096


def usable(c: str, dim: int):
    v = F.col(c)
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        half = 0 if spherical else 0.5 * (c * c).sum(1)
        own = np.concatenate([np.argmax(x[i : i + 8192] @ c.T - half, 1) for i in range(0, len(x), 8192)])
        n = np.bincount(own, minlength=k)
        for d in range(x.shape[1]):
            c[:, d] = np.bincount(own, x[:, d], k) / np.maximum(n, 1)
        empty = np.flatnonzero(n == 0)
        c[empty] = x[rng.integers(0, len(x), len(empty))]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _two_levels(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """About ``k`` spherical centroids: the square root of ``k`` groups, each split by its share of the rows."""
    coarse = _kmeans(x, max(1, int(np.sqrt(k))), rounds, rng, True)
    own = np.argmax(x @ coarse.T, 1)
    parts = []
    for j in range(len(coarse)):
        inside = x[own == j]
        many = min(len(inside), int(np.ceil(k * len(inside) / len(x))))
        if many:
            parts.append(_kmeans(inside, many, rounds, rng, True))
    return np.concatenate(parts)


def _own(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and how similar it is."""
    own, sim = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    for i in range(0, len(x), 4096):
        s = x[i : i + 4096] @ c.T
        own[i : i + 4096] = np.argmax(s, 1)
        sim[i : i + 4096] = s.max(1)
    return own, sim


def _to_the_core(x: np.ndarray, c: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Each centroid moved to the mean of the nearer half of its rows.

    A dense topic among scattered rows so gets its centroid into its middle, and the short
    residuals there are coded finely.
    """
    for _ in range(rounds):
        own, sim = _own(x, c)
        order = np.lexsort((-sim, own))
        first = np.searchsorted(own[order], np.arange(len(c)))
        n = np.bincount(own, minlength=len(c))
        keep = order[np.arange(len(x)) - first[own[order]] < (n[own[order]] + 1) // 2]
        mean = np.stack([np.bincount(own[keep], x[keep, d], len(c)) for d in range(x.shape[1])], 1)
        size = np.linalg.norm(mean, axis=1, keepdims=True)
        c = np.where(size > 1e-9, mean / np.maximum(size, 1e-9), c).astype(np.float32)
    return c


def centroids_for(rows: int) -> int:
    return int(min(MAX_CENTROIDS, max(4, 2 ** int(np.round(np.log2(max(4.0, rows / PER_CENTROID)))))))


class Index:
    """Centroids and the codebooks of residual directions."""

    def __init__(self, sample: np.ndarray, rows: int, m: int, rounds: int = 10):
        rng = np.random.default_rng(7)
        dim = sample.shape[1]
        self.m = m if dim % m == 0 else 1
        self.centroids = _two_levels(sample, max(1, min(centroids_for(rows), len(sample) // 8)), rounds, rng)
        self.centroids = _to_the_core(sample, self.centroids)
        own, _ = _own(sample, self.centroids)
        res = self._across(sample, self.centroids[own])[1]
        res = (res / np.maximum(np.linalg.norm(res, axis=1, keepdims=True), 1e-12))[: 4 * MAX_TRAIN]
        w = dim // self.m
        self.books = np.stack([_kmeans(np.ascontiguousarray(res[:, j * w : (j + 1) * w]), 256, rounds, rng, False) for j in range(self.m)])

    def near(self, x: np.ndarray, p: int) -> np.ndarray:
        """The ``p`` nearest centroids of each row, nearest first."""
        s = x @ self.centroids.T
        p = min(p, s.shape[1])
        part = np.argpartition(-s, p - 1, 1)[:, :p]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), 1, kind="stable"), 1)

    @staticmethod
    def _across(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The length of each row along its centroid, and its part across."""
        along = (x * c).sum(1)
        return along, x - along[:, None] * c

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the residuals' directions, the parts along the centroids (less what the code has of it), the residuals' lengths and their errors."""
        c, w = self.centroids[home], x.shape[1] // self.m
        along, res = self._across(x, c)
        size = np.linalg.norm(res, axis=1)
        flat = res / np.maximum(size, 1e-12)[:, None]
        code, back = np.empty((len(x), self.m), np.uint8), np.empty_like(res)
        for j in range(self.m):
            b = self.books[j]
            code[:, j] = np.argmax(flat[:, j * w : (j + 1) * w] @ b.T - 0.5 * (b * b).sum(1), 1)
            back[:, j * w : (j + 1) * w] = b[code[:, j]]
        size = size.astype(np.float16)
        long = size.astype(np.float32)
        slant, flat_back = self._across(back, c)
        error = np.linalg.norm(res - long[:, None] * flat_back, axis=1)
        return code, (along - long * slant).astype(np.float32), size, (error * 1.001 + 1e-4).astype(np.float16)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query the product of its parts with each codebook entry: (m, queries, 256)."""
        w = q.shape[1] // self.m
        return np.stack([q[:, j * w : (j + 1) * w] @ self.books[j].T for j in range(self.m)])

    def similarity(self, q: np.ndarray, home: np.ndarray, along: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Asymmetric similarities of full queries and coded entries, and by what an entry's error is multiplied in them."""
        cells, at = np.unique(home, return_inverse=True)
        part = np.zeros((len(q), len(home)), np.float32)
        for t, c in zip(self.tables(q), code.T):
            part += np.take(t, c, axis=1)
        part *= size.astype(np.float32)
        to = q @ self.centroids[cells].T
        part += np.take(to, at, axis=1) * along
        return part, np.take(np.sqrt(np.maximum(1 - to * to, 0)) + 1e-3, at, axis=1)


def _unit(frame_col: pd.Series, dim: int) -> np.ndarray:
    x = np.array(frame_col.tolist(), np.float64).reshape(-1, dim)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _packs(cell: np.ndarray, query: bool, most: int, row: np.ndarray, *columns: np.ndarray) -> pd.DataFrame:
    """The given rows of the columns, brought together by cell: one binary of at most ``most`` rows each."""
    order = np.argsort(cell, kind="stable")
    cell, row = cell[order], row[order]
    cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(cell)]
    out = [(a, min(b, a + most)) for lo, b in zip(cuts, ends) for a in range(lo, b, most)]
    body = [b"".join(np.ascontiguousarray(c[row[a:b]]).tobytes() for c in columns) for a, b in out]
    return pd.DataFrame({"cell": np.array([cell[a] for a, _ in out], np.int32), "query": query, "n": np.array([b - a for a, b in out], np.int32), "body": body})


def _unpack(f: pd.DataFrame, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """Ids and further columns (type, width) of packs."""
    parts: list[list[np.ndarray]] = [[] for _ in range(len(kinds) + 1)]
    for n, body in zip(f["n"], f["body"]):
        at = 0
        for k, (kind, width) in enumerate([("<i8", 1), *kinds]):
            x = np.frombuffer(body, kind, n * width, at)
            parts[k].append(x.reshape(n, width) if k else x)
            at += x.nbytes
    return [np.concatenate(p) for p in parts]


def nearest(rows: DataFrame, k: int = 5, key: str = "id", vector: str = "vector", dim: int = 64, queries=None, min_similarity: float | None = None, candidates: int = 256, spread: int | None = None, probes: int | None = None, m: int = M, block: int = BLOCK, max_train: int = MAX_TRAIN) -> DataFrame:
    """The ``k`` most similar vectors of each vector: ``<key>, neighbour, cosine, rank``.

    ``queries`` is a condition on ``<key>`` for the rows that ask (all by default); all
    rows are searched. The ``candidates`` best by table distance are reranked. With
    ``min_similarity`` only neighbours at least so similar are given, and only entries whose
    bound reaches it are candidates. A vector that is
    null, of another length than ``dim``, holds a null, NaN or infinite number, or is all
    zero, takes no part. A null key takes no part, repeated rows of a key count once (the
    smallest vector), ties are ordered by key. An empty table gives an empty result.
    """
    spark: SparkSession = rows.sparkSession
    asks = F.lit(True) if queries is None else queries
    spread = (SPREAD if queries is None else 1) if spread is None else spread
    probes = (1 if queries is None else PROBES) if probes is None else probes
    good = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v")).filter(F.col("id").isNotNull() & usable("v", dim))
    # copies: one representative by content; only ids and hashes are shuffled
    hashed = good.select("id", F.xxhash64("v").alias("h1"), F.hash("v", F.lit(7)).alias("h2")).groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h"))
    member = checkpoint(hashed.withColumn("__hot", F.pmod(F.xxhash64("id"), F.lit(64))).groupBy("h", "__hot").agg(F.min("id").alias("lo"), F.collect_list("id").alias("ids")))
    rep = member.groupBy("h").agg(F.min("lo").alias("rep"), F.sum(F.size("ids")).alias("n"))
    copied = checkpoint(rep.filter("n > 1"))
    n_rows = rep.count()
    schema = f"{key} long, neighbour long, cosine double, rank int"
    if n_rows == 0:
        return spark.createDataFrame([], schema)
    member_ids = copied.join(member, "h").select("rep", F.explode("ids").alias("id"))  # classes of two and more only
    copies = checkpoint(member_ids)
    lone = good.join(copies.filter("id <> rep").select("id"), "id", "left_anti")
    fitted = max(max_train, 8 * centroids_for(n_rows))
    some = lone if n_rows <= fitted else lone.filter(F.pmod(F.xxhash64("id"), F.lit(n_rows)) < fitted)
    fit = Index(_unit(some.toPandas().sort_values("id")["v"], dim), n_rows, m)
    shared = spark.sparkContext.broadcast(fit)

    def file_under(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for f in frames:
            if not len(f):
                continue
            x, ids = _unit(f["v"], dim), f["id"].values.astype("<i8")
            near = np.concatenate([index.near(x[i : i + 1024], max(spread, probes)) for i in range(0, len(x), 1024)])
            under, asked_in = near[:, :spread], near[:, :probes]
            home = near[:, 0].astype("<i4")
            code, along, size, error = index.encode(x, near[:, 0])
            yield _packs(under.ravel(), False, block, np.repeat(np.arange(len(x)), under.shape[1]), ids, home, along, size, error, code)
            q = np.flatnonzero(f["ask"].values)
            if len(q):
                yield _packs(asked_in[q].ravel(), True, block, np.repeat(q, asked_in.shape[1]), ids, x)

    filed = lone.select("id", "v", F.coalesce(asks_on(asks, key), F.lit(False)).alias("ask"))
    if queries is not None and copies_exist(copied):  # a copy that asks makes its representative ask
        ask_rep = copies.filter(asks_on(asks, key)).select(F.col("rep").alias("id"), F.lit(True).alias("also")).distinct()
        filed = filed.join(ask_rep, "id", "left").select("id", "v", (F.col("ask") | F.coalesce("also", F.lit(False))).alias("ask"))
    filed = checkpoint(filed.mapInPandas(file_under, "cell int, query boolean, n int, body binary"))
    # cells beyond the block size become a grid of blocks; the counts are two a centroid
    size = {(r["cell"], r["query"]): r["count"] for r in filed.groupBy("cell", "query").agg(F.sum("n").alias("count")).collect()}
    cells = {c for c, _ in size}
    grid = [(int(c), int(max(1, -(-size.get((c, True), 0) // block))), int(max(1, -(-size.get((c, False), 0) // (4 * block))))) for c in cells]
    grid_df = F.broadcast(spark.createDataFrame(grid, "cell int, nq int, nm int"))
    own_q, own_m = F.pmod(F.xxhash64("body"), F.col("nq")).cast("int"), F.pmod(F.xxhash64("body"), F.col("nm")).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("query"), F.col("nm")).otherwise(F.col("nq")) - 1)
    placed = filed.join(grid_df, "cell").withColumn("o", F.explode(other))
    placed = placed.select("cell", F.when(F.col("query"), own_q).otherwise(F.col("o")).alias("bq"), F.when(F.col("query"), F.col("o")).otherwise(own_m).alias("bm"), "query", "n", "body")

    def search(f: pd.DataFrame) -> pd.DataFrame:
        index, isq = shared.value, f["query"].values
        qf, mf = f[isq], f[~isq]
        out = []
        if len(qf) and len(mf):
            qi, q = _unpack(qf, ("<f4", dim))
            mi, home, along, size, error, code = _unpack(mf, ("<i4", 1), ("<f4", 1), ("<f2", 1), ("<f2", 1), ("u1", index.m))
            home, along, size, error = home.ravel(), along.ravel(), size.ravel(), error.ravel().astype(np.float32)
            for i in range(0, len(q), 256):
                s, reach = index.similarity(q[i : i + 256], home, along, size, code)
                s[qi[i : i + 256, None] == mi[None, :]] = -2
                if min_similarity is not None:
                    s[s + error * reach < min_similarity] = -2
                c = min(candidates, s.shape[1])
                b = np.argpartition(-s, c - 1, 1)[:, :c].ravel()
                a = np.repeat(np.arange(len(s)), c)
                a, b = a[s[a, b] > -2], b[s[a, b] > -2]
                out.append(pd.DataFrame({"a": qi[i + a], "b": mi[b], "s": s[a, b]}))
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "s": np.zeros(0, np.float32)})

    pairs = placed.groupBy("cell", "bq", "bm").applyInPandas(search, "a long, b long, s float")
    if spread > 1 and probes > 1:  # two may meet under several centroids
        pairs = pairs.groupBy("a", "b").agg(F.max("s").alias("s"))
    w = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    pairs = pairs.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= candidates)
    # a pair is computed once, whichever of the two asked, or both
    low, asked = F.least("a", "b").alias("lo"), F.when(F.col("a") < F.col("b"), 1).otherwise(2)
    pairs = checkpoint(pairs.select(low, F.greatest("a", "b").alias("hi"), asked.alias("by")).groupBy("lo", "hi").agg(F.bit_or("by").alias("by")))
    # exact rerank: each pair fetches its two vectors; only the vectors named by a pair are moved
    named = pairs.select(F.explode(F.array("lo", "hi")).alias("id")).distinct()
    vectors = checkpoint(lone.join(named, "id", "left_semi").dropDuplicates(["id"]))
    both = pairs.join(vectors.select(F.col("id").alias("lo"), F.col("v").alias("va")), "lo").join(vectors.select(F.col("id").alias("hi"), F.col("v").alias("vb")), "hi")

    @F.pandas_udf(T.DoubleType())
    def cosine(va: pd.Series, vb: pd.Series) -> pd.Series:
        x, y = (np.array(c.tolist(), np.float64).reshape(-1, dim) for c in (va, vb))
        x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
        return pd.Series((x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)))

    exact = both.select("lo", "hi", "by", cosine("va", "vb").alias("cosine"))
    if min_similarity is not None:
        exact = exact.filter(F.col("cosine") >= min_similarity)
    ways = F.filter(F.array(F.when(F.col("by").bitwiseAND(1) > 0, F.struct(F.col("lo").alias("a"), F.col("hi").alias("b"))), F.when(F.col("by").bitwiseAND(2) > 0, F.struct(F.col("hi").alias("a"), F.col("lo").alias("b")))), lambda x: x.isNotNull())
    exact = exact.select(F.inline(ways), "cosine")
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    exact = exact.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")
    # give the copies back: the first k+1 members of each class can be anyone's neighbours
    first = Window.partitionBy("rep").orderBy("id")
    head = copies.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).drop("r")
    heads = head.groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("members"))
    asking = exact.join(copies.select(F.col("rep").alias("a"), "id"), "a", "left").select(F.coalesce("id", "a").alias("a"), "b", "cosine")
    asking = asking.join(heads.select(F.col("rep").alias("b"), "members"), "b", "left").select("a", F.explode(F.coalesce("members", F.array("b"))).alias("b"), "cosine")
    inside = copies.join(heads, "rep").select(F.col("id").alias("a"), F.explode("members").alias("b"), F.lit(1.0).alias("cosine")).filter("a <> b")
    every = asking.unionByName(inside).filter(asks_on(asks, key, "a"))
    ranked = every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("a").alias(key), F.col("b").alias("neighbour"), "cosine", "rank")


def asks_on(asks, key: str, column: str = "id"):
    """The condition of the queries, which is written on ``key``, as one on ``column``."""
    return asks(F.col(column)) if callable(asks) else asks


def copies_exist(copied: DataFrame) -> bool:
    return bool(copied.limit(1).count())


def exact_nearest(rows: DataFrame, queries, k: int = 10, key: str = "id", vector: str = "vector", dim: int = 64, block: int = 8_192) -> DataFrame:
    """The same by brute force, for a stated query set: ``<key>, neighbour, cosine, rank``.

    ``queries`` (a condition on ``<key>``) are held against all rows in blocks: a task sees one
    block of queries and one of rows, and gives ``k`` rows a query. Unusable vectors, null keys
    and repeated rows as in ``nearest``.
    """
    spark = rows.sparkSession
    good = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v")).filter(F.col("id").isNotNull() & usable("v", dim))
    good = checkpoint(good.groupBy("id").agg(F.min("v").alias("v")))
    ask = good.filter(queries(F.col("id")))
    nq, nm = (max(1, -(-df.count() // block)) for df in (ask, good))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = ask.select(own(nq).alias("bq"), F.explode(F.sequence(F.lit(0), F.lit(nm - 1))).alias("bm"), F.lit(True).alias("q"), "id", "v")
    right = good.select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("bq"), own(nm).alias("bm"), F.lit(False).alias("q"), "id", "v")

    def best(f: pd.DataFrame) -> pd.DataFrame:
        qf, mf, out = f[f["q"]], f[~f["q"]], []
        if len(qf) and len(mf):
            x, ids, asks_ = _unit(mf["v"], dim), mf["id"].values, qf["id"].values
            q = _unit(qf["v"], dim)
            for i in range(0, len(q), 256):
                s = q[i : i + 256] @ x.T
                s[asks_[i : i + 256, None] == ids[None, :]] = -2
                c = min(k, s.shape[1])
                b = np.argpartition(-s, c - 1, 1)[:, :c].ravel()
                a = np.repeat(np.arange(len(s)), c)
                out.append(pd.DataFrame({"a": asks_[i + a], "b": ids[b], "cosine": s[a, b].astype(float)})[s[a, b] > -2])
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "cosine": np.zeros(0)})

    found = left.unionByName(right).groupBy("bq", "bm").applyInPandas(best, "a long, b long, cosine double")
    order = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("a").alias(key), F.col("b").alias("neighbour"), "cosine", "rank")


def _field(spark: SparkSession, folder: str, field: str) -> DataFrame:
    return table(spark, folder, "semantic_vectors").select(F.col("chunk_id").alias("id"), F.col(field).alias("vector"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks with a cosine of at least 0.92, one among the other's five most similar."""
    out = None
    for field in ("vector", "body"):
        near = nearest(_field(spark, folder, field), 5, min_similarity=0.92, candidates=128, spread=12)  # so near, they share a centroid
        pair = near.select(F.lit(field).alias("field"), F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()
        out = pair if out is None else out.unionByName(pair)
    return out


def asked(c):
    """The stated query set: every chunk whose id is divisible by 100."""
    return c % 100 == 0


def p1_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten most similar chunks of every chunk whose id is divisible by 100, among all chunks."""
    near = nearest(_field(spark, folder, "vector"), 10, queries=asked)
    return near.select(F.col("id").alias("chunk_id"), F.col("neighbour"), F.round("cosine", 6).alias("cosine"), "rank")


def p1_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Per field the queries, and whether the search finds at least 95 % of their ten nearest by brute force.

    A neighbour counts if its cosine reaches that of the tenth true one, so ties do no harm.
    """
    out = None
    for field in ("vector", "body"):
        rows = _field(spark, folder, field)
        true = exact_nearest(rows, asked, 10).groupBy("id").agg(F.min("cosine").alias("least"), F.count("*").alias("wanted"))
        got = nearest(rows, 10, queries=asked).join(true.select("id", "least"), "id").filter(F.col("cosine") >= F.col("least") - 1e-6).groupBy("id").agg(F.count("*").alias("found"))
        both = true.join(got, "id", "left").agg(F.count("*").alias("queries"), F.sum("wanted").alias("wanted"), (F.sum(F.least("wanted", F.coalesce("found", F.lit(0)))) >= 0.95 * F.sum("wanted")).alias("enough"))
        both = both.select(F.lit(field).alias("field"), "queries", F.coalesce("wanted", F.lit(0)).alias("wanted"), F.coalesce("enough", F.lit(True)).alias("enough"))
        out = both if out is None else out.unionByName(both)
    return out


QUERIES = {"p1_found": p1_found, "p1_search": p1_search, "p1_recall": p1_recall}
_USABLE = "len(v) = 64 AND len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0"
SQL = {
    "p1_recall": f"""
WITH r AS (SELECT DISTINCT 'vector' AS field, chunk_id, vector AS v FROM semantic_vectors UNION ALL SELECT DISTINCT 'body', chunk_id, body FROM semantic_vectors),
u AS (SELECT field, chunk_id, count(*) OVER (PARTITION BY field) AS n FROM r WHERE {_USABLE})
SELECT f.field, count(u.chunk_id) AS queries, coalesce(sum(least(10, n - 1)), 0)::BIGINT AS wanted, true AS enough FROM (SELECT unnest(['vector', 'body']) AS field) f LEFT JOIN u ON u.field = f.field AND u.chunk_id % 100 = 0 GROUP BY f.field"""
}
