"""The published index: clean fact tables as one generation, written once and read by every search.

Repeats are removed and lines are brought to their files here, so a search reads what it
needs and moves only what it finds. Lines lie sorted by path, postings are cut into folders
by a hash of the term and sorted by it, so a query reads the folders of its terms only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.operators import chunks, extract, lexical, lexicon, structure, symbols, vectors
from siftspark.session import checkpoint
from siftspark.sources import facts
from siftspark.streaming import generations

BUCKETS = 64
MODEL = "hashed-shake-256"


def bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of the index of a data folder."""
    lines = facts.lines(spark, folder)
    own = facts.chunks(spark, folder)
    postings = lexical.postings(lines).withColumn("bucket", bucket("term"))
    return {
        "files": facts.files(spark, folder), "lines": lines.repartitionByRange("path", "line_no").sortWithinPartitions("path", "line_no"),
        "symbols": facts.symbols(spark, folder), "calls": facts.calls(spark, folder), "chunks": own, "imports": symbols.import_edges(lines),
        "postings": postings.repartition("bucket").sortWithinPartitions("bucket", "term"), "statistics": lexical.statistics(lines),
        "nodes": structure.nodes(extract.extract(facts.sources(spark, folder))).repartitionByRange("signature").sortWithinPartitions("signature"),
        "associations": lexicon.top(lexicon.ppmi(lexicon.observations(own.filter("symbol_name IS NOT NULL")))),
        "texts": own.select("path", "line_start", "line_end", "symbol_name", chunks.rendered().alias("text")),
    }


def build(spark: SparkSession, folder: str, root: str, failed: DataFrame | None = None) -> int:
    """Write and publish the index of ``folder`` below ``root``; strict if ``failed`` is given."""
    return generations.publish(spark, root, tables(spark, folder), MODEL, failed, {"postings": ["bucket"]})


@dataclass(frozen=True)
class Index:
    """The tables of one generation; all reads of a search see the same one."""

    spark: SparkSession
    root: str | None
    generation: int
    folder: str | None = None

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if self.root is None:
            return tables(self.spark, self.folder)[name]
        return generations.read(self.spark, self.root, name, self.generation)

    def postings_of(self, terms: list[str]) -> DataFrame:
        """The postings of some terms, from their folders only."""
        wanted = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(bucket("t")).distinct().collect()]
        return self.postings.filter(F.col("bucket").isin(*wanted) & F.col("term").isin(*terms)).drop("bucket")

    def bm25(self, terms: list[str], limit: int = 100) -> DataFrame:
        return lexical.bm25_indexed(self.postings_of(terms), self.statistics, terms, limit)


def open_index(spark: SparkSession, root: str, model: str = MODEL) -> Index:
    """The current generation, after a check that its vectors are of the active model."""
    generations.same_identity(spark, root, model)
    return Index(spark, root, generations.current(spark, root))


def over(spark: SparkSession, folder: str) -> Index:
    """The same tables straight from a data folder, for searches without a published index."""
    return Index(spark, None, 0, folder)


SAMPLE = 16_384  # vectors on which the inverted file's centroids are fitted


def build_vectors(spark: SparkSession, texts: DataFrame, root: str) -> int:
    """Embed the chunk texts (``path, line_start, line_end, symbol_name, text``) and publish their inverted file.

    Tables ``vectors`` (with their cell, a folder each) and ``centroids`` (at most 256 rows); the
    identity holds the model and a fingerprint of the vectors, so a stale file is noticed.
    """
    import numpy as np

    own = checkpoint(texts.withColumn("id", F.xxhash64("path", "line_start", "symbol_name", "text")).withColumn("vector", vectors.embed_hashed("text")))
    n = own.count()
    sample = own.filter(F.pmod(F.xxhash64("id"), F.lit(max(n, 1))) < SAMPLE).orderBy("id").select("vector").toPandas()["vector"]
    c = vectors.ivf_fit(np.array(sample.tolist(), float), n) if len(sample) else np.zeros((1, vectors.DIM))
    cells = own.join(vectors.ivf_assign(own.select("id", "vector").dropDuplicates(["id"]), "id", "vector", c).select("id", "cell"), "id")
    centroids = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(c)], "cell int, centroid array<double>")
    identity = f"{MODEL}:{vectors.fingerprint(own, 'id', 'vector')}"
    return generations.publish(spark, root, {"vectors": cells, "centroids": centroids}, identity, None, {"vectors": ["cell"]})


def semantic(spark: SparkSession, root: str, text: str, k: int = 50, probes: int | None = None) -> DataFrame:
    """The ``k`` chunks nearest to a text: ``path, line_start, line_end, symbol_name, sim``.

    From two thousand vectors on the nearest cells are read, by default nine tenths of them; below, all.
    """
    import numpy as np

    from siftspark.plans.search import use_ann

    state = generations.pointer(spark, root)
    if state["identity"].split(":", 1)[0] != MODEL:
        raise generations.IdentityError(f"the index holds vectors of {state['identity']!r}, not of {MODEL!r}")
    held, q = generations.read(spark, root, "vectors"), np.array(vectors.embed_text(text))
    if use_ann(int(state["identity"].split(":")[1]), None):
        c = generations.read(spark, root, "centroids").orderBy("cell").toPandas()
        near = np.argsort(-(np.array(c["centroid"].tolist()) @ q), kind="stable")[: probes or max(1, int(0.9 * len(c)))]
        held = held.filter(F.col("cell").isin(*[int(c["cell"].iloc[i]) for i in near]))
    sim = vectors.cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in q]))
    return held.withColumn("sim", sim).filter(F.col("sim") > vectors.MIN_SIMILARITY).orderBy(F.desc("sim"), "path", "line_start").limit(k).select("path", "line_start", "line_end", "symbol_name", "sim")
