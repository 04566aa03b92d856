"""Symbol channels: definitions, callers, imports, anchors, and how sure a call's target is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.sources.facts import ascii_lower

EXACT, PART = 5.0, 2.0
DEF_BASE, CALL_BASE, GRAPH, ANCHOR, IMPORT = 3.0, 1.5, 5.0, 6.0, 2.0
POOL = 500


def same_name(c: Column, name: str) -> Column:
    return ascii_lower(c) == ascii_lower(F.lit(name))


def score_symbol(symbol: Column, term: str) -> Column:
    """5 for the name itself, 2 for a part either way (two characters or more), else 0."""
    low, t = F.lower(symbol), F.lit(term.lower())
    part = (F.length(low) >= 2) & (F.lit(len(term)) >= 2) & (low.contains(t) | t.contains(low))
    return F.when(low == t, EXACT).when(part, PART).otherwise(0.0)


def coverage(symbol: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [score_symbol(symbol, t) for t in terms], F.lit(0.0))


def _scored(symbol: Column, terms: list[str], base: float) -> Column:
    total = coverage(symbol, terms)
    return F.when(total > 0, 2 * total + base).otherwise(0.0)


def score_def(symbol: Column, terms: list[str]) -> Column:
    return _scored(symbol, terms, DEF_BASE)


def score_caller(symbol: Column, terms: list[str]) -> Column:
    return _scored(symbol, terms, CALL_BASE)


def kind_weight(kind: Column) -> Column:
    return F.when(kind.isin("function", "method"), 1.0).otherwise(0.65)


def any_part(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [ascii_lower(c).contains(ascii_lower(F.lit(t))) for t in terms], F.lit(False))


def defs(symbols: DataFrame, name: str, terms: list[str], pool: int = POOL) -> DataFrame:
    """Definitions of ``name`` in any ASCII case; functions and methods first."""
    rows = symbols.filter(same_name(F.col("name"), name))
    first = F.when(F.col("kind").isin("function", "method"), 0).otherwise(1)
    rows = rows.orderBy(first, "path", "byte_start").limit(pool)
    return rows.select(F.lit("def").alias("hit"), F.col("path").alias("file"), "line_start", "line_end", F.col("name").alias("symbol"), F.col("kind").alias("symbol_kind"), (score_def(F.col("name"), terms) * kind_weight(F.col("kind"))).alias("score"))


def callers(calls: DataFrame, name: str, terms: list[str], pool: int = POOL) -> DataFrame:
    """Each call of ``name``: once as its caller and once as an edge."""
    rows = calls.filter(same_name(F.col("callee"), name)).orderBy("path", "line_no", "caller", "callee").limit(pool)
    one = F.explode(F.array(F.struct(F.lit("caller").alias("hit"), F.col("caller").alias("symbol"), score_caller(F.col("callee"), terms).alias("score")), F.struct(F.lit("graph").alias("hit"), F.col("callee").alias("symbol"), F.lit(GRAPH).alias("score"))))
    return rows.select(F.col("path").alias("file"), F.col("line_no").alias("line_start"), "caller", "callee", one.alias("h")).select("h.hit", "file", "line_start", "caller", "callee", "h.symbol", "h.score")


def import_edges(lines: DataFrame) -> DataFrame:
    """Module paths of import statements, by language."""
    text = F.trim("content")
    quoted = F.regexp_extract(text, r"^(?:import\b.*?|export\b.*?\bfrom\s*|require(?:_relative)?\s*\(?|#\s*include\s*)[\"'<]([^\"'>]+)[\"'>]", 1)
    plain = F.regexp_extract(text, r"^(?:from|import|use|using|package)\s+(?:static\s+)?([A-Za-z_][\w.:\\]*)", 1)
    module = F.when(F.col("language") == "rust", F.regexp_replace(plain, "::", "/")).otherwise(plain)
    found = F.when(quoted != "", quoted).when((module != "") & ~text.startswith("package"), module)
    rows = lines.filter(F.col("content").rlike(r"^\s*(?:from|import|export|use|using|require|#\s*include)\b"))
    return rows.select("path", "language", "line_no", found.alias("module")).filter("module IS NOT NULL")


def imports(edges: DataFrame, target: str) -> DataFrame:
    """Imports whose module holds ``target``; an empty target lists all."""
    return edges.filter(ascii_lower(F.col("module")).contains(ascii_lower(F.lit(target)))).select("path", "line_no", "module", F.lit(IMPORT).alias("score"))


def anchors(symbols: DataFrame, name: str, terms: list[str]) -> DataFrame:
    """Symbols like the query's main name; the score grows with the terms they hold."""
    rows = symbols.filter(ascii_lower(F.col("name")).contains(ascii_lower(F.lit(name))))
    held = reduce(lambda a, b: a + b, [F.lower("name").contains(t).cast("int") for t in terms], F.lit(0))
    return rows.select("path", "name", "line_start", F.round(F.when(held > 0, ANCHOR * F.sqrt(held / float(max(len(terms), 1)))).otherwise(0.0), 6).alias("score"))


def resolution(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """How sure each call's target is: unique in its file, unique in the corpus, ambiguous or a mere name.

    Definitions are counted per name and per (file, name) before the joins.
    """
    named = symbols.select(ascii_lower(F.col("name")).alias("low"), F.col("path").alias("in_path"))
    here = named.groupBy("low", "in_path").agg(F.count("*").alias("n_file"))
    repo = named.groupBy("low").agg(F.count("*").alias("n_repo"))
    rows = calls.withColumn("low", ascii_lower(F.col("callee")))
    rows = rows.join(here, (rows.low == here.low) & (rows.path == here.in_path), "left").drop(here.low).drop("in_path")
    rows = rows.join(repo, "low", "left").fillna(0, ["n_file", "n_repo"])
    tier = F.when(F.col("n_file") == 1, "file_local_unique").when(F.col("n_repo") == 1, "repository_unique").when(F.col("n_repo") == 0, "name_only").otherwise("ambiguous")
    return rows.drop("low").withColumn("resolution", tier)


# From the surest to the least sure (fixed order).
PRECISION = ("compiler_resolved", "import_resolved", "file_local_unique", "scip_occurrence", "repository_unique", "name_only", "ambiguous")
PRECISE = PRECISION[:3]


def precise(resolution: Column) -> Column:
    """Is the tier one that names its target for certain?"""
    return resolution.isin(*PRECISE)


def per_file(symbols: DataFrame, name: str) -> DataFrame:
    """How many definitions of a name each file holds."""
    return symbols.filter(same_name(F.col("name"), name)).groupBy("path").agg(F.count("*").alias("n"))


def texts(symbols: DataFrame, lines: DataFrame, files: DataFrame, most: int = 1600, block: int = 64) -> DataFrame:
    """``symbol_id, text``: the lines of each definition, each cut to ``most`` characters, joined by blanks.

    ``symbols`` and ``lines`` belong to ``files`` by ``file_id``; repeated lines count once. Files of
    one path share their definitions. Definitions meet blocks of ``block`` lines, so no file's
    lines all meet its definitions. The joins are merges, since no estimate of size counts what
    a definition is spread over, and what is taken to be small would be sent to the driver.
    """
    at = files.select("file_id", "path")
    own = symbols.filter("line_start <= line_end").select("file_id", "symbol_id", "line_start", "line_end").hint("merge")
    own = own.join(at, "file_id").select("path", "symbol_id", "line_start", "line_end").hint("merge").join(at, "path")
    of = lambda c: F.expr(f"{c} div {block}")
    want = own.select("file_id", F.explode(F.sequence(of("line_start"), of("line_end"))).alias("block"), "symbol_id", "line_start", "line_end")
    line = F.struct("line_no", F.substring("content", 1, most).alias("t"), F.when(F.length("content") > most, F.sha2("content", 256)).alias("rest"))
    packed = lines.groupBy("file_id", of("line_no").alias("block")).agg(F.collect_set(line).alias("ls"))
    packed = packed.select("file_id", "block", F.transform("ls", lambda x: F.struct(x.line_no.alias("line_no"), x.t.alias("t"))).alias("ls"))
    inside = F.filter("ls", lambda x: x.line_no.between(F.col("line_start"), F.col("line_end")))
    held = want.hint("merge").join(packed, ["file_id", "block"]).select("symbol_id", inside.alias("ls"))
    whole = held.groupBy("symbol_id").agg(F.sort_array(F.flatten(F.collect_list("ls"))).alias("ls")).filter(F.size("ls") > 0)
    return whole.select("symbol_id", F.when(F.exists("ls", lambda x: x.t.isNotNull()), F.array_join(F.transform("ls", lambda x: x.t), " ")).alias("text"))


def best(symbol: Column, terms: list[str]) -> Column:
    """The highest score of any term."""
    return F.greatest(F.lit(0.0), F.lit(0.0), *[score_symbol(symbol, t) for t in terms])


def scip_upgrade(resolved: DataFrame, facts: DataFrame) -> DataFrame:
    """Raise a call's tier where an overlay names it at the same place; never lower it."""
    seen = facts.filter("NOT is_def").select(F.col("path").alias("s_path"), F.col("line_no").alias("s_line"), ascii_lower(F.col("name")).alias("s_name")).distinct()
    on = (resolved.path == F.col("s_path")) & (resolved.line_no == F.col("s_line")) & (ascii_lower(resolved.callee) == F.col("s_name"))
    rank = F.array_position(F.array(*[F.lit(p) for p in PRECISION]), F.col("resolution"))
    better = F.col("s_name").isNotNull() & (rank > PRECISION.index("scip_occurrence") + 1)
    return resolved.join(seen, on, "left").withColumn("resolution", F.when(better, "scip_occurrence").otherwise(F.col("resolution"))).drop("s_path", "s_line", "s_name")


def enclosing(symbols: DataFrame) -> DataFrame:
    """For each function the smallest class around it: ``symbol_id, scope``.

    Lines are cut into buckets, so a file's symbols meet by bucket and not all with all.
    """
    bucket = 64
    outer = symbols.filter("kind IN ('class', 'type', 'interface', 'enum')").select("path", F.col("name").alias("scope"), F.col("byte_start").alias("b0"), F.col("byte_end").alias("b1"), F.explode(F.sequence((F.col("line_start") / bucket).cast("int"), (F.col("line_end") / bucket).cast("int"))).alias("bucket"))
    inner = symbols.filter("kind IN ('function', 'method')").select("path", "symbol_id", "byte_start", "byte_end", (F.col("line_start") / bucket).cast("int").alias("bucket"))
    held = inner.join(outer, ["path", "bucket"]).filter("b0 < byte_start AND b1 >= byte_end")
    return held.groupBy("symbol_id").agg(F.min(F.struct((F.col("b1") - F.col("b0")).alias("span"), "scope")).alias("m")).select("symbol_id", F.col("m.scope").alias("scope"))


def tightest(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """The tightest symbol at each (path, line_no)."""
    bucket = 64
    own = symbols.select("path", "name", "line_start", "line_end", F.explode(F.sequence((F.col("line_start") / bucket).cast("int"), (F.col("line_end") / bucket).cast("int"))).alias("bucket"))
    at = places.select("path", "line_no", (F.col("line_no") / bucket).cast("int").alias("bucket"))
    held = at.join(own, ["path", "bucket"]).filter("line_no BETWEEN line_start AND line_end")
    best = Window.partitionBy("path", "line_no").orderBy((F.col("line_end") - F.col("line_start")), "line_start", "name")
    return held.withColumn("r", F.row_number().over(best)).filter("r = 1").select("path", "line_no", "name")
