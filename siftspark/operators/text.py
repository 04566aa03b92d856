"""Exact channels over lines: literal, word, regular expression, context and file caps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.plans.query import QueryError, glob_regex, required_literal
from siftspark.sources.facts import ascii_lower, language

SMALL = 1000  # from this many lines on an exact match scores 1 whatever its rank
POOL = 200


def split_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """A row per line, ``line_no`` from 1; one carriage return at a line's end is dropped; an empty text is one empty line."""
    parts = F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("__pos", "__line")
    return texts.select("*", parts).select(*[c for c in texts.columns if c != text], (F.col("__pos") + 1).alias("line_no"), F.regexp_replace("__line", "\r$", "").alias("content"))


def literal(content: Column, needle: str, ignore_case: bool = False) -> Column:
    return ascii_lower(content).contains(ascii_lower(F.lit(needle))) if ignore_case else content.contains(needle)


def word(content: Column, needle: str) -> Column:
    """The needle where no letter, digit or underscore touches it."""
    return content.contains(needle) & content.rlike(rf"(?<![\p{{L}}\p{{N}}_])\Q{needle}\E(?![\p{{L}}\p{{N}}_])")


def regex(content: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Line-level expression; a literal that every match holds is tested first."""
    if len(pattern) > 4096:
        raise QueryError("the expression is too long")
    try:
        re.compile(pattern)
    except re.error as error:
        raise QueryError(f"not an expression: {error}") from error
    test = content.rlike(("(?i)" if ignore_case else "") + pattern)
    need = None if ignore_case else required_literal(pattern)
    return content.contains(need) & test if need else test


def in_language(rows: DataFrame, name: str | None) -> DataFrame:
    return rows if name is None else rows.filter(F.col("language") == language(F.lit(name)))


def in_files(rows: DataFrame, glob: str | None) -> DataFrame:
    return rows if glob is None else rows.filter(F.col("path").rlike(glob_regex(glob)))


def scan(lines: DataFrame, test: Column, pool: int = POOL, total: int | None = None) -> DataFrame:
    """The first ``pool`` matching lines in (path, line) order as hits.

    In a corpus of fewer than a thousand lines the score falls with the rank, else it is 1.
    """
    found = lines.filter(test).select("path", "language", "line_no", "content").orderBy("path", "line_no").limit(pool)
    flat = total is None or total >= SMALL
    rank = F.row_number().over(Window.orderBy("path", "line_no")) - 1  # over at most ``pool`` rows
    score = F.lit(1.0) if flat else F.lit(1.0) / (F.lit(1.0) + F.lit(0.01) * rank)
    return found.select(F.lit("asgrep").alias("kind"), F.col("path").alias("file"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), "language", score.alias("score"), F.col("content").alias("excerpt"))


def per_file_first(hits: DataFrame, keep: int = 3, cap: int = 100) -> DataFrame:
    """The first ``keep`` of each file in order, then the overflow, ``cap`` in all."""
    nth = F.row_number().over(Window.partitionBy("file").orderBy("line_start"))
    late = (nth > keep).cast("int")
    return hits.withColumn("late", late).orderBy("late", "file", "line_start").limit(cap)


def count_only(hits: DataFrame) -> DataFrame:
    return hits.groupBy("file").agg(F.count("*").alias("n"))


def context(hits: DataFrame, lines: DataFrame, around: int = 2) -> DataFrame:
    """Replace each hit's excerpt by its lines with ``around`` more on either side."""
    near = hits.select("file", "line_start", "line_end", F.explode(F.sequence(F.greatest(F.col("line_start") - around, F.lit(1)), F.col("line_end") + around)).alias("line_no"))
    own = lines.select(F.col("path").alias("file"), "line_no", "content")
    got = near.join(own, ["file", "line_no"]).groupBy("file", "line_start", "line_end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x.content), "\n").alias("excerpt"))
    return hits.drop("excerpt").join(got, ["file", "line_start", "line_end"], "left")


def read_node(lines: DataFrame, file: str, start: int, end: int, around: int = 0) -> DataFrame:
    """The window of lines that a reference ``path#Lstart-Lend`` names."""
    rows = lines.filter((F.col("path") == file) & F.col("line_no").between(max(1, start - around), end + around))
    return rows.select("line_no", "content").orderBy("line_no")
