"""The hybrid cascade: lines narrow the files, structure narrows them again, meaning fills in.

Each stage is a semi-join with the files of the stage before; those are at most ``FILES``,
so that side is broadcast. Ranks are taken after the pools, which are bounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.operators import fusion, lexicon, symbols, text, vectors
from siftspark.operators.structure import by_terms
from siftspark.plans.query import Query, limit, parse, primary_symbol
from siftspark.session import checkpoint

LINES_PER_TERM, FILES, FANOUT, PARENTS = 100, 100, 16, 4


def prefilter(lines: DataFrame, terms: list[str]) -> DataFrame:
    """Per term the first hundred lines that hold it, in (path, line) order: ``term, file, line_start, score``.

    The lines are read once for all terms. Each term's first lines are taken by a grouped
    limit, which keeps that many rows per term and task.
    """
    tests = F.array(*[F.when(text.literal(F.col("content"), t, ignore_case=True), F.lit(t)) for t in terms])
    found = lines.select("path", "language", "line_no", "content", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("term"))
    nth = F.row_number().over(Window.partitionBy("term").orderBy("path", "line_no"))
    first = found.withColumn("r", nth).filter(F.col("r") <= LINES_PER_TERM)
    return first.select("term", F.col("path").alias("file"), F.col("line_no").alias("line_start"), "language", "content", (F.lit(1.0) / (1.0 + 0.01 * (F.col("r") - 1))).alias("score"))


def top_files(evidence: DataFrame, most: int = FILES) -> DataFrame:
    """The files with most evidence: scores weighted by the length of their terms."""
    return evidence.groupBy("file").agg(F.round(F.sum(F.col("score") * F.length("term")), 6).alias("weight")).orderBy(F.desc("weight"), "file").limit(most)


def structural(symbol_rows: DataFrame, calls: DataFrame, files: DataFrame, query: Query) -> DataFrame:
    """Definitions, callers and anchors inside the given files."""
    terms = list(query.terms)
    inside = F.broadcast(files.select(F.col("file").alias("path")))
    own = symbol_rows.join(inside, "path", "left_semi")
    edges = calls.join(inside, "path", "left_semi")
    defs = own.filter(symbols.any_part(F.col("name"), terms)).select(F.lit("def").alias("kind"), F.col("path").alias("file"), "line_start", "line_end", F.col("name").alias("symbol"), (symbols.score_def(F.col("name"), terms) * symbols.kind_weight(F.col("kind"))).alias("score"))
    using = edges.filter(symbols.any_part(F.col("callee"), terms)).select(F.lit("caller").alias("kind"), F.col("path").alias("file"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.col("caller").alias("symbol"), symbols.score_caller(F.col("callee"), terms).alias("score"))
    name = primary_symbol(query.target, query.terms)
    anchor = symbols.anchors(own, name, terms) if name else own.limit(0).select("path", "name", "line_start", F.lit(0.0).alias("score"))
    anchor = anchor.select(F.lit("anchor").alias("kind"), F.col("path").alias("file"), "line_start", F.col("line_start").alias("line_end"), F.col("name").alias("symbol"), "score")
    return fusion.union(defs, using, anchor).filter("score > 0").orderBy(F.desc("score"), "file", "line_start", "symbol").limit(symbols.POOL)


def working_files(lexical: DataFrame, structure: DataFrame) -> DataFrame:
    """The files that structure found, or those of the lines if it found none (decided in the plan)."""
    narrow = structure.select("file").distinct()
    n = F.broadcast(narrow.agg(F.count("*").alias("n")))
    wide = lexical.select("file").distinct().crossJoin(n).filter("n = 0").select("file")
    return narrow.unionByName(wide)


def semantic(chunk_vectors: DataFrame, files: DataFrame, query: Query, pool: int, more: list[str] | None = None) -> DataFrame:
    """Embedding hits inside the given files: chunks ranked by similarity and grouped to their parents.

    ``more`` terms widen the query. Without a column ``vector`` the texts in the files are embedded.
    """
    vector = vectors.embed_text(" ".join([query.target, *(more or [])]))
    rows = chunk_vectors if files is None else chunk_vectors.join(files.select(F.col("file").alias("path")), "path", "left_semi")
    if "vector" not in rows.columns:
        rows = rows.withColumn("vector", vectors.embed_hashed("text"))
    q = F.array(*[F.lit(float(x)) for x in vector])
    ranked = rows.select("path", "line_start", "line_end", "symbol_name", "text", vectors.cosine(F.col("vector"), q).alias("sim")).filter(F.col("sim") > vectors.MIN_SIMILARITY)
    best = vectors.parents(ranked, ["path", "line_start", "line_end", "symbol_name"], "text")
    return best.orderBy(F.desc("score"), "path", "line_start").limit(max(50, pool)).select(F.lit("embed").alias("kind"), F.col("path").alias("file"), "line_start", "line_end", F.col("symbol_name").alias("symbol"), "score")


def fanout(embed: DataFrame, calls: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """For the best four semantic parents up to sixteen calls of each, as callers and as edges, and as many pattern nodes."""
    best = embed.filter("symbol IS NOT NULL").groupBy("symbol").agg(F.max("score").alias("s")).orderBy(F.desc("s"), "symbol").limit(PARENTS)
    rows = calls.join(F.broadcast(best.select(F.col("symbol").alias("callee"))), "callee")
    nth = F.row_number().over(Window.partitionBy("callee").orderBy("path", "line_no", "caller"))
    first = rows.withColumn("r", nth).filter(F.col("r") <= FANOUT)
    place = [F.col("path").alias("file"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end")]
    found = first.select(F.lit("caller").alias("kind"), *place, F.col("caller").alias("symbol"), F.lit(symbols.EXACT * 2 + symbols.CALL_BASE).alias("score"))
    if nodes is not None:
        own = nodes.join(F.broadcast(best.select(F.explode(F.array(F.concat(F.lit("call-name:"), "symbol"), F.concat(F.lit("decl:fn:"), "symbol"), F.concat(F.lit("decl:def:"), "symbol"), F.concat(F.lit("decl:function:"), "symbol"))).alias("signature"), "symbol")), "signature")
        at = F.row_number().over(Window.partitionBy("symbol").orderBy("path", "line_start", "signature"))
        own = own.withColumn("r", at).filter(F.col("r") <= FANOUT)
        found = found.unionByName(own.select(F.lit("pattern").alias("kind"), F.col("path").alias("file"), "line_start", "line_end", "symbol", F.lit(0.85 * 7.0).alias("score")))
    return found.unionByName(first.select(F.lit("graph").alias("kind"), *place, F.col("callee").alias("symbol"), F.lit(symbols.GRAPH).alias("score")))


def search(raw: str, lines: DataFrame, symbol_rows: DataFrame, calls: DataFrame, chunk_vectors: DataFrame | None = None, most: int | None = None, associations: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Free-text search as one plan: ``position, file, line_start, kind, score, contributors, critic``.

    ``associations`` give a conceptual query up to five related terms; they widen the candidate
    files and the semantic query only.
    """
    query, keep = parse(raw), limit(most)
    terms = sorted(query.terms, key=lambda t: (-len(t), t))
    more = []
    if associations is not None and chunk_vectors is not None and query.intent == "conceptual":
        more = [r["related"] for r in lexicon.expand(associations, [t.lower() for t in terms]).collect()]
    candidates = checkpoint(prefilter(lines, terms + more))  # at most a hundred rows a term, used four times
    evidence = candidates.filter(F.col("term").isin(terms))
    files = top_files(candidates)
    files = checkpoint(files)
    structure = checkpoint(structural(symbol_rows, calls, files, query))  # a bounded pool, used twice
    working = working_files(files, structure)
    lexical = evidence.join(F.broadcast(working), "file", "left_semi").select(F.lit("asgrep").alias("kind"), "file", "line_start", F.col("line_start").alias("line_end"), F.lit(None).cast("string").alias("symbol"), "score")
    found = [lexical, structure]
    if nodes is not None:
        inside = F.broadcast(files.select(F.col("file").alias("path")))
        found.append(by_terms(nodes.join(inside, "path", "left_semi"), terms).drop("excerpt"))
    if chunk_vectors is not None:
        found.append(checkpoint(semantic(chunk_vectors, F.broadcast(checkpoint(working)), query, keep, more)))  # a bounded page: texts are embedded once
        if query.intent == "conceptual":
            found.append(fanout(found[-1], calls, nodes))
    hits = fusion.union(*found).withColumn("score", fusion.normalise(F.col("score"), F.col("kind"), len(terms)))
    hits = hits.withColumn("q", F.lit(0)).withColumn("intent", F.lit(query.intent))
    fused = fusion.critic(fusion.weighted_rrf(hits, ["q"]))
    placed = fusion.promote_definition(fusion.per_file_cap(fused, ["q"]), ["q"], keep)
    return placed.filter(F.col("position") <= keep).drop("q", "intent").orderBy("position")


def coverage(excerpt, terms: list[str]):
    """How many terms stand in the excerpt as whole words; cased terms must match their case."""
    one = [(excerpt.rlike(rf"(?<![\p{{L}}\p{{N}}_])\Q{t}\E(?![\p{{L}}\p{{N}}_])") if t != t.lower() else F.lower(excerpt).rlike(rf"(?<![\p{{L}}\p{{N}}_])\Q{t}\E(?![\p{{L}}\p{{N}}_])")).cast("int") for t in terms]
    return reduce(lambda a, b: a + b, one, F.lit(0))
