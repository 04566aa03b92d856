"""A search as a user runs it: the mode's channel, conjunctions, and the finish of a response."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.operators import conjunction, fusion, structure, symbols, text
from siftspark.plans import hybrid
from siftspark.plans.query import Conjunction, Query, QueryError, limit, parse, parse_conjunction, primary_symbol

ALL = 2_000_000_000  # a side of a conjunction is not cut to a page
ANN_FROM = 2000


@dataclass(frozen=True)
class Options:
    """What a caller may ask for besides the query."""

    limit: int | None = None
    language: str | None = None
    glob: str | None = None
    ignore_case: bool = True
    pool: int | None = None  # rows that a channel may give; by default at least 200


def pool_of(options: Options) -> int:
    return options.pool or max(text.POOL, limit(options.limit))


def use_ann(rows: int, language: str | None, least: int = ANN_FROM) -> bool:
    """An inverted file answers only from ``least`` vectors on, and not below a language filter."""
    return rows >= least and language is None


def _lines(ix, options: Options) -> DataFrame:
    return text.in_files(text.in_language(ix.lines, options.language), options.glob)


def _own(rows: DataFrame, options: Options) -> DataFrame:
    return text.in_files(text.in_language(rows, options.language), options.glob)


def _line_mode(ix, query: Query, options: Options, nodes: DataFrame | None) -> DataFrame:
    c = F.col("content")
    test = {"literal": lambda: text.literal(c, query.target, options.ignore_case), "word": lambda: text.word(c, query.target), "regex": lambda: text.regex(c, query.target)}[query.mode]()
    return text.scan(_lines(ix, options), test, pool_of(options)).withColumn("symbol", F.lit(None).cast("string"))


def _defs(ix, query: Query, options: Options, nodes: DataFrame | None) -> DataFrame:
    rows = symbols.defs(_own(ix.symbols, options), query.target, list(query.terms), options.pool or symbols.POOL)
    return rows.select(F.lit("def").alias("kind"), "file", "line_start", "line_end", "symbol", "score")


def _callers(ix, query: Query, options: Options, nodes: DataFrame | None) -> DataFrame:
    edges = symbols.resolution(_own(ix.calls, options).filter(symbols.same_name(F.col("callee"), query.target)), ix.symbols.filter(symbols.same_name(F.col("name"), query.target)))
    rows = symbols.callers(edges, query.target, list(query.terms), options.pool or symbols.POOL)
    tier = edges.select(F.col("path").alias("file"), F.col("line_no").alias("line_start"), "caller", "callee", "resolution").groupBy("file", "line_start", "caller", "callee").agg(F.min("resolution").alias("resolution"))
    out = rows.join(tier, ["file", "line_start", "caller", "callee"], "left")
    return out.select(F.col("hit").alias("kind"), "file", "line_start", F.col("line_start").alias("line_end"), "symbol", "score", "caller", "callee", "resolution")


def _imports(ix, query: Query, options: Options, nodes: DataFrame | None) -> DataFrame:
    rows = symbols.imports(_own(ix.imports, options), query.target)
    return rows.select(F.lit("import").alias("kind"), F.col("path").alias("file"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.col("module").alias("symbol"), "score")


def _pattern(ix, query: Query, options: Options, nodes: DataFrame | None) -> DataFrame:
    if nodes is None:
        raise QueryError("a pattern needs the structural index")
    sources, index = nodes
    return structure.find(_own_paths(index, options), _own(sources, options), query.target)


def _own_paths(index: DataFrame, options: Options) -> DataFrame:
    return text.in_files(index, options.glob)


def _semantic(ix, query: Query, options: Options, nodes: DataFrame | None) -> DataFrame:
    files = ix.files.select(F.col("path").alias("file"), "language", "path")
    inside = None if options.language is None and options.glob is None else _own(files, options)
    return hybrid.semantic(ix.texts, inside, query, options.pool or limit(options.limit))


CHANNELS = {"literal": _line_mode, "word": _line_mode, "regex": _line_mode, "defs": _defs, "callers": _callers, "imports": _imports, "pattern": _pattern, "semantic": _semantic}


def channel(ix, query: Query, options: Options = Options(), nodes=None) -> DataFrame:
    """The raw hits of one mode: ``kind, file, line_start, line_end, symbol, score`` and what the mode adds."""
    return CHANNELS[query.mode](ix, query, options, nodes)


def conjunct(ix, both: Conjunction, options: Options = Options(), nodes=None) -> DataFrame:
    """Left hits that a right hit supports (or none does); each side is exhaustive.

    A pattern and call edges are compared by span, all else by file. A hit on the first or last
    line of the other's span counts only if that side's text names the symbol. Kept hits take
    over the contributors of the right hits that overlap them.
    """
    whole = replace(options, pool=ALL)
    left, right = (channel(ix, q, whole, nodes).withColumn("contributors", F.array("kind")) for q in (both.left, both.right))
    if both.scope == "span":
        inside = conjunction.within(left, right, both.negated)
        return inside if both.negated else conjunction.merge_evidence(inside, right)
    return conjunction.and_file(left, right, both.negated)


def coverage(excerpt: Column, terms: list[str]) -> Column:
    return hybrid.coverage(excerpt, terms) if terms else F.lit(0)


def affinity(symbol: Column, terms: list[str]) -> Column:
    """3 for a snake-case name, 2 for another, whose parts all are words of the query; else 0."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(symbol, r"(?<=[a-z0-9])(?=[A-Z])", "_")), "[^a-z0-9]+"), lambda x: x != "")
    known = F.array(*[F.lit(t.lower()) for t in terms]) if terms else F.array().cast("array<string>")
    held = (F.size(parts) > 0) & (F.size(F.array_except(parts, known)) == 0)
    return F.coalesce(F.when(held, F.when(symbol.contains("_"), 3).otherwise(2)), F.lit(0))


def finish(hits: DataFrame, query: Query, options: Options = Options(), rerank=None) -> DataFrame:
    """A response: repeats merged, filtered, with margins and confidence, ordered, gated and cut.

    Several terms order by coverage, then score; one term by score, then coverage. Three hits
    of a file come first, a definition takes the last place if the page has none. ``rerank`` may
    reorder the page (a function of the DataFrame); without it the order stands.
    """
    keep = limit(options.limit)
    for name, kind in (("signal", "string"), ("contributors", "array<string>"), ("language", "string"), ("excerpt", "string"), ("caller", "string"), ("callee", "string"), ("resolution", "string")):
        if name not in hits.columns:
            hits = hits.withColumn(name, F.lit(None).cast(kind))
    rows = hits.withColumn("signal", F.coalesce("signal", fusion.signal(F.col("kind")))).withColumn("q", F.lit(0))
    best = F.max(F.struct(F.coalesce("score", F.lit(float("-inf"))).alias("s"), (-fusion.priority(F.col("kind"))).alias("p"), "excerpt", "resolution"))
    detail = rows.groupBy("q", "file", "line_start", "line_end", "symbol", "caller", "callee").agg(best.alias("b"))
    one = fusion.dedup(rows, ["q"], ["caller", "callee"])
    same = [one[c].eqNullSafe(detail[c]) for c in ("q", "file", "line_start", "line_end", "symbol", "caller", "callee")]
    one = one.join(detail, same, "left").select(one["*"], F.col("b.excerpt").alias("excerpt"), F.col("b.resolution").alias("resolution"))
    one = text.in_files(one.withColumn("path", F.col("file")), options.glob).drop("path")
    terms = sorted(query.terms)
    one = fusion.margins(one, ["q"]).withColumn("confidence", fusion.confidence(F.col("signal"), F.col("contributors")))
    one = one.withColumn("coverage", coverage(F.coalesce("excerpt", "symbol", F.lit("")), terms)).withColumn("affinity", affinity(F.coalesce("symbol", F.lit("")), terms))
    first = [F.desc("coverage"), F.desc("score")] if len(terms) > 1 else [F.desc("score"), F.desc("coverage")]
    order = [*first, F.desc("affinity"), F.asc("file"), F.asc("line_start"), F.asc("line_end"), F.asc_nulls_first("symbol"), F.asc("kind")]
    nth = F.row_number().over(Window.partitionBy("file").orderBy(*order))
    late = (F.col("nth") > 3).cast("int")
    page = one.withColumn("nth", nth).orderBy(late, *order).limit(max(4 * keep, keep + 32))  # the only global order is over a page
    placed = page.withColumn("position", F.row_number().over(Window.orderBy((F.col("nth") > 3).cast("int"), *order)))
    heads = one.filter("kind = 'def'").orderBy(*order).limit(1)
    placed = placed.unionByName(heads.withColumn("nth", F.lit(0)).withColumn("position", F.lit(max(4 * keep, keep + 32) + 1)), allowMissingColumns=True)
    again = F.row_number().over(Window.partitionBy("file", "line_start", "line_end", "symbol", "caller", "callee", "kind").orderBy("position"))
    placed = placed.withColumn("again", again).filter("again = 1").drop("again", "nth")
    out = fusion.promote_definition(placed, ["q"], keep).filter(F.col("position") <= keep)
    if rerank is not None:
        out = rerank(out)
    return out.drop("q", "merged", "affinity")


def search(ix, raw: str, options: Options = Options(), nodes=None, rerank=None) -> DataFrame:
    """Answer a query of any form from an index (``plans.index``); ``nodes`` are (sources, pattern nodes)."""
    if both := parse_conjunction(raw):
        return finish(conjunct(ix, both, options, nodes), both.left, options, rerank)
    query = parse(raw)
    if not query.target:
        raise QueryError("nothing is asked for")
    if query.mode != "hybrid":
        return finish(channel(ix, query, options, nodes), query, options, rerank)
    index = nodes[1] if nodes is not None else None
    return hybrid.search(raw, _lines(ix, options), _own(ix.symbols, options), _own(ix.calls, options), _own(ix.texts, options) if "language" in ix.texts.columns else ix.texts, options.limit, ix.associations, index)


def reranked(page: DataFrame, scores: DataFrame, top: int) -> DataFrame:
    """Reorder the first ``top`` hits by supplied scores ``position, rerank``; the rest keeps its order.

    Only finite scores of places that occur once count; a hit without one keeps its place behind them.
    """
    good = scores.filter(fusion.finite(F.col("rerank"))).groupBy("position").agg(F.count("*").alias("n"), F.first("rerank").alias("rerank")).filter(F.col("n") == 1).filter(F.col("position") <= top).drop("n")
    out = page.join(good, "position", "left")
    order = Window.orderBy(F.col("rerank").isNull().cast("int"), F.desc("rerank"), "position")
    return out.withColumn("position", F.row_number().over(order)).drop("rerank")


def filter_hits(hits: DataFrame, kinds: list[str] | None = None, glob: str | None = None, min_score: float | None = None, most: int | None = None, fields: list[str] | None = None) -> DataFrame:
    """Hits of some kinds, paths and scores, the first ``most`` in order, and only some fields."""
    out = hits if kinds is None else hits.filter(F.col("kind").isin(*kinds))
    out = text.in_files(out.withColumn("path", F.col("file")), glob).drop("path")
    out = out if min_score is None else out.filter(F.col("score") >= min_score)
    out = out if most is None else out.orderBy(F.desc("score"), "file", "line_start").limit(most)
    return out if fields is None else out.select(*fields)
