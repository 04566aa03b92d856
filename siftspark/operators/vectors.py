"""Vector channel: similarity, gates, grouping to parents, field mixes and hashed embeddings."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_SIMILARITY = float(np.nextafter(np.float32(0.08), np.float32(1)))
EMBED, DIM = 4.0, 256
FIELDS = ("name", "docs", "body", "graph", "tests_examples")
# Words that stand for one concept: a text with a trigger gets the group's terms (fixed values).
CONCEPTS = (
    ("auth authentication login credential session bearer", "auth authentication login credential session token bearer oauth identity"),
    ("refresh renewal renew rotate revoke", "refresh renewal renew rotate revoke update reissue"),
    ("token jwt apikey api_key secret", "token jwt apikey api_key secret credential key"),
    ("request http fetch client api", "request http fetch client api endpoint call"),
    ("validate validation verify check sanitize", "validate validation verify check sanitize guard"),
    ("store persist save cache database db", "store persist save cache database db write"),
    ("error exception panic fail fault", "error exception panic fail fault handler"),
    ("test spec mock fixture assert", "test spec mock fixture assert unittest"),
)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 for other lengths, empty or zero vectors and numbers that are not finite."""
    sim = dot(a, b) / (norm(a) * norm(b))
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(ok & sim.isNotNull() & ~F.isnan(sim) & (F.abs(sim) != float("inf")), sim).otherwise(0.0)


def nearest(vectors: DataFrame, query: list[float], key: str, vector: str, k: int, floor: float = MIN_SIMILARITY) -> DataFrame:
    """The ``k`` most similar rows above the floor, ties by key: a scan with a bounded top-k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.select(key, *[c for c in ("label",) if c in vectors.columns], cosine(F.col(vector), q).alias("sim"))
    return rows.filter(F.col("sim") > floor).orderBy(F.desc("sim"), key).limit(k)


def parents(ranked: DataFrame, parent: list[str], text: str, keep: int = 3) -> DataFrame:
    """Chunks to their parents: the best similarity and up to three distinct texts, best first."""
    distinct = ranked.groupBy(*parent, text).agg(F.max("sim").alias("sim"))
    nth = F.row_number().over(Window.partitionBy(*parent).orderBy(F.desc("sim"), text))
    best = distinct.withColumn("r", nth).filter(F.col("r") <= keep)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", text))), lambda x: x[text]), "\n...\n")
    return best.groupBy(*parent).agg(F.max("sim").alias("sim"), joined.alias("excerpt")).withColumn("score", F.round(F.col("sim") * EMBED, 6))


def field_mix(fields: Column, weights: Column, primary: Column) -> Column:
    """The weighted mean of the field similarities that are there; the primary one if none is."""
    pairs = [(fields[f].cast("double"), weights[f].cast("double")) for f in FIELDS]
    ok = [v.isNotNull() & ~F.isnan(v) & (w > 0) for v, w in pairs]
    top = sum((F.when(o, v * w).otherwise(0.0) for o, (v, w) in zip(ok, pairs)), F.lit(0.0))
    below = sum((F.when(o, w).otherwise(0.0) for o, (v, w) in zip(ok, pairs)), F.lit(0.0))
    return F.when(below > 0, top / below).otherwise(primary)


def _words(text: str) -> list[str]:
    found = set()
    for w in re.split(r"[^\w]+", text):
        if len(w) >= 2:
            found.add(w.lower())
        for piece in re.split(r"_", w):
            for part in re.findall(r"[A-Z]?[^A-Z]+|[A-Z]", piece):
                if len(part) >= 2:
                    found.add(part.lower())
    return sorted(found)


def expand_concepts(text: str) -> str:
    own = set(_words(text))
    more = {t for triggers, terms in CONCEPTS if own & set(triggers.split()) for t in terms.split()}
    return f"{text} {' '.join(sorted(more | own))}"


KEPT = 65_536  # sign rows that a worker keeps (256 bytes each)


class _Signs:
    """The sign row of each feature, one byte a dimension, in one table that is emptied when full."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.empty((1024, DIM), np.int8)

    def rows(self, features: list[str]) -> np.ndarray:
        if len(self.place) + len(features) > max(KEPT, len(features)):
            self.place.clear()
        at = np.empty(len(features), np.int64)
        for k, f in enumerate(features):
            i = self.place.get(f)
            if i is None:
                i = self.place[f] = len(self.place)
                if i >= len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                raw = np.frombuffer(hashlib.shake_256(f.encode()).digest(DIM), np.uint8)
                self.table[i] = np.where(raw & 1, 1, -1)
            at[k] = i
        return self.table[at]


_SIGNS = _Signs()


def embed_text(text: str) -> list[float]:
    """A hashed vector: a random sign per feature and dimension, words weigh 1 and byte trigrams 0.35.

    The features of a text and how often they occur are one product with their table of signs.
    """
    full = expand_concepts(text)
    words = _words(full)
    flat = np.frombuffer("".join(c for c in full.lower() if c.isalnum()).encode(), np.uint8).astype(np.uint32)
    codes, often = np.unique((flat[:-2] << 16) | (flat[1:-1] << 8) | flat[2:], return_counts=True) if len(flat) > 2 else (np.zeros(0, np.uint32), np.zeros(0))
    features = [*(f"tok:{w}" for w in words), *(f"tri:{c:06x}" for c in codes.tolist())]
    if not features:
        return [0.0] * DIM
    weight = np.concatenate([np.ones(len(words)), 0.35 * often]).astype(np.float32)
    out = weight @ _SIGNS.rows(features).astype(np.float32)
    size = float(np.linalg.norm(out))
    return (out / size if size else out).tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed_hashed(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(embed_text)


def embed_missing(texts: DataFrame, cache: DataFrame | None, model: str = "hashed-shake-256") -> DataFrame:
    """``chunk_hash, model_id, vector``: only texts that the cache does not hold are embedded."""
    keyed = texts.select(F.sha2("text", 256).alias("chunk_hash"), "text").dropDuplicates(["chunk_hash"])
    if cache is None:
        return keyed.select("chunk_hash", F.lit(model).alias("model_id"), embed_hashed("text").alias("vector"))
    known = cache.filter(F.col("model_id") == model)
    fresh = keyed.join(known, "chunk_hash", "left_anti").select("chunk_hash", F.lit(model).alias("model_id"), embed_hashed("text").alias("vector"))
    return known.select("chunk_hash", "model_id", "vector").unionByName(fresh)


def ivf_fit(sample: np.ndarray, rows: int, rounds: int = 12) -> np.ndarray:
    """Centroids for an inverted file: sqrt(rows) of them within 16 and 256, far points first, spherical."""
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    k = int(min(len(x), max(16, min(256, int(np.sqrt(rows))))))
    picked, near = [0], x @ x[0]
    while len(picked) < k:
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        for j in range(k):
            if (own == j).any():
                m = x[own == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def ivf_assign(rows: DataFrame, key: str, vector: str, centroids: np.ndarray) -> DataFrame:
    """``<key>, vector, cell``: each row's nearest centroid (at most 256, shared with the tasks)."""
    c = centroids

    @F.pandas_udf(T.IntegerType())
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(np.argmax(np.array(v.tolist(), np.float64) @ c.T, 1).astype("int32")) if len(v) else pd.Series([], dtype="int32")

    return rows.select(key, vector, cell(vector).alias("cell"))


def ivf_search(assigned: DataFrame, query: list[float], key: str, vector: str, centroids: np.ndarray, k: int, probes: int | None = None) -> DataFrame:
    """The ``k`` best of the probed cells, rescored exactly; by default nine tenths of the cells are probed."""
    n = len(centroids)
    p = max(1, min(n - 1 if n > 1 else 1, int(0.9 * n) if not probes else probes))
    q = np.array(query, float)
    cells = [int(i) for i in np.argsort(-(centroids @ q), kind="stable")[:p]]
    return nearest(assigned.filter(F.col("cell").isin(cells)), query, key, vector, k)


def with_lines(chunk_vectors: DataFrame, line_vectors: DataFrame, most: int = 5000) -> DataFrame:
    """Chunk vectors, and line vectors of an older index for files that have no chunks, ``most`` of them in order."""
    old = line_vectors.join(chunk_vectors.select("path").distinct(), "path", "left_anti").orderBy("path", "line_start").limit(most)
    return chunk_vectors.unionByName(old, allowMissingColumns=True)


def fingerprint(vectors: DataFrame, key: str, vector: str) -> str:
    """One text for the content of a vector table, whatever the order of its rows."""
    r = vectors.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(key, vector)).alias("x"), F.sum(F.xxhash64(vector, key).bitwiseAND(0xFFFFFFFF)).alias("s")).first()
    return f"{r['n']}:{(r['x'] or 0) & 0xFFFFFFFFFFFFFFFF:x}:{r['s'] or 0:x}"
