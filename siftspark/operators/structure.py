"""The structural index: pattern nodes by signature, and semantic chunks built from extracted facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.operators import extract
from siftspark.plans.query import signatures, term_signatures

SCORE, WEIGHT = 7.0, 0.85
DOC_LINES, CHILDREN, BUCKET = 8, 2, 64


def nodes(facts: DataFrame) -> DataFrame:
    """``signature, path, line_start, line_end, excerpt``: the index, each signature once a line."""
    rows = facts.filter("fact = 'pattern'").select(F.col("name").alias("signature"), "path", "line_start", "line_end", "excerpt")
    return rows.dropDuplicates(["signature", "path", "line_start"])


def _hits(rows: DataFrame, symbol: Column, score: float) -> DataFrame:
    return rows.select(F.lit("pattern").alias("kind"), F.col("path").alias("file"), "line_start", "line_end", symbol.alias("symbol"), F.lit(score).alias("score"), "excerpt")


def lookup(index: DataFrame, pattern: str) -> DataFrame | None:
    """Hits of a pattern that the index answers by signature; None where it cannot."""
    wanted = signatures(pattern)
    return _hits(index.filter(F.col("signature").isin(*wanted)), F.lit(pattern), SCORE).dropDuplicates(["file", "line_start", "line_end"]) if wanted else None


def by_terms(index: DataFrame, terms: list[str]) -> DataFrame:
    """The structural pass of a free search: six signatures for each term of three letters or more."""
    wanted = [s for t in terms if len(t) >= 3 and t.isidentifier() for s in term_signatures(t)]
    rows = index.filter(F.col("signature").isin(*wanted)) if wanted else index.limit(0)
    return _hits(rows, F.col("signature"), WEIGHT * SCORE).dropDuplicates(["file", "line_start", "line_end"])


def find(index: DataFrame, sources: DataFrame, pattern: str) -> DataFrame:
    """Index and native matches together, one row a span; the index's row is kept."""
    native = extract.match_pattern(sources, pattern)
    found = _hits(native, F.lit(pattern), SCORE).withColumn("late", F.lit(1))
    indexed = lookup(index, pattern)
    both = found if indexed is None else indexed.withColumn("late", F.lit(0)).unionByName(found)
    first = F.row_number().over(Window.partitionBy("file", "line_start", "line_end").orderBy("late", "excerpt"))
    return both.withColumn("n", first).filter("n = 1").drop("n", "late")


def is_comment(language: Column, content: Column) -> Column:
    """Is the line a comment of the language?"""
    text = F.ltrim(content)
    hashes = language.isin("python", "ruby")
    return F.when(hashes, text.startswith("#")).otherwise(text.rlike(r"^(?://|/\*|\*)") | ((language == "php") & text.startswith("#")))


def doc_above(symbols: DataFrame, lines: DataFrame, most: int = DOC_LINES) -> DataFrame:
    """``path, line_start, doc``: up to eight comment lines that stand without a gap above a definition."""
    near = symbols.select("path", "line_start").distinct().withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(most))))
    near = near.withColumn("line_no", F.col("line_start") - F.col("back")).filter("line_no > 0")
    held = near.join(lines.select("path", "line_no", "content", is_comment(F.col("language"), F.col("content")).alias("is")), ["path", "line_no"])
    upto = Window.partitionBy("path", "line_start").orderBy("back").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = held.withColumn("all", F.min(F.col("is").cast("int")).over(upto)).withColumn("n", F.count("*").over(upto)).filter("all = 1 AND n = back")
    text = F.trim(F.regexp_replace(F.regexp_replace("content", r"^\s*(?:///?!?|//!|#+!?|/\*+!?|\*+/?)\s?", ""), r"\s*\*+/\s*$", ""))
    lines_ = F.transform(F.array_sort(F.collect_list(F.struct("line_no", text.alias("t")))), lambda x: x.t)
    return kept.groupBy("path", "line_start").agg(F.trim(F.array_join(lines_, "\n")).alias("doc"))


def scopes(facts: DataFrame) -> DataFrame:
    """``path, byte_start, scope``: the smallest type-like definition around each function."""
    own = facts.filter("fact = 'symbol'")
    cut = lambda c: (F.col(c) / BUCKET).cast("int")
    outer = own.filter("kind NOT IN ('function', 'method')").select("path", F.col("name").alias("scope"), F.col("byte_start").alias("b0"), F.col("byte_end").alias("b1"), F.explode(F.sequence(cut("line_start"), cut("line_end"))).alias("bucket"))
    inner = own.filter("kind IN ('function', 'method')").select("path", "byte_start", "byte_end", cut("line_start").alias("bucket"))
    held = inner.join(outer, ["path", "bucket"]).filter("b0 < byte_start AND b1 >= byte_end")
    return held.groupBy("path", "byte_start").agg(F.min(F.struct((F.col("b1") - F.col("b0")).alias("n"), "scope")).alias("m")).select("path", "byte_start", F.col("m.scope").alias("scope"))


def build_chunks(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """Semantic chunks of extracted facts: one per function or method.

    The text is that of at most two nodes inside it (calls and declarations before kinds,
    shorter ones first), or its own where it holds none. Callers and callees are those of the same file, the
    documentation stands above, the scope is the smallest type around. Containment goes by
    buckets of lines, so a long file's nodes do not all meet.
    """
    own = facts.filter("fact = 'symbol' AND kind IN ('function', 'method')").select("path", "language", "kind", "name", "line_start", "line_end", "byte_start", "byte_end", F.col("excerpt").alias("own"))
    cut = lambda c: (F.col(c) / BUCKET).cast("int")
    outer = own.select("path", "byte_start", "byte_end", F.explode(F.sequence(cut("line_start"), cut("line_end"))).alias("bucket"))
    rank = F.when(F.col("name").rlike("^(?:call|decl):"), 0).when(F.col("name").startswith("kind:"), 1).otherwise(2)
    inner = facts.filter("fact = 'pattern'").select("path", cut("line_start").alias("bucket"), F.col("byte_start").alias("b0"), F.col("byte_end").alias("b1"), rank.alias("rank"), "excerpt")
    held = outer.join(inner, ["path", "bucket"]).filter("b0 > byte_start AND b1 <= byte_end").groupBy("path", "byte_start", "excerpt").agg(F.min("rank").alias("rank"), F.min("b0").alias("b0"))
    nth = F.row_number().over(Window.partitionBy("path", "byte_start").orderBy("rank", F.length("excerpt"), "b0", "excerpt"))
    best = held.withColumn("n", nth).filter(F.col("n") <= CHILDREN)
    text = best.groupBy("path", "byte_start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "excerpt"))), lambda x: x.excerpt), "\n").alias("inside"))
    calls = facts.filter("fact = 'call'").select("path", "caller", "name").distinct()
    callers = calls.groupBy("path", "name").agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    callees = calls.groupBy("path", F.col("caller").alias("name")).agg(F.array_sort(F.collect_set("name")).alias("callees"))
    none = F.array().cast("array<string>")
    out = own.join(text, ["path", "byte_start"], "left").join(callers, ["path", "name"], "left").join(callees, ["path", "name"], "left")
    out = out.join(doc_above(own, lines), ["path", "line_start"], "left").join(scopes(facts), ["path", "byte_start"], "left")
    return out.select("path", "language", "kind", F.col("name").alias("symbol_name"), "line_start", "line_end", F.coalesce("inside", "own").alias("excerpt"), F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"), "doc", "scope")
