"""The engine's functions by name, for SQL of the user's own."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftspark.operators import chunks, extract, lexical, vectors
from siftspark.plans.query import pattern
from siftspark.sources.facts import LOWER, UPPER

# SQL bodies, so Catalyst sees through them.
SQL = {
    "ascii_lower": f"(s STRING) RETURNS STRING RETURN translate(s, '{UPPER}', '{LOWER}')",
    "rrf": "(rank BIGINT) RETURNS DOUBLE RETURN 1.0D / (61.0D + rank)",
    "score_symbol": "(term STRING, sym STRING) RETURNS DOUBLE RETURN CASE WHEN lower(sym) = lower(term) THEN 5.0D WHEN length(sym) >= 2 AND length(term) >= 2 AND (contains(lower(sym), lower(term)) OR contains(lower(term), lower(sym))) THEN 2.0D ELSE 0.0D END",
    "kind_weight": "(kind STRING) RETURNS DOUBLE RETURN CASE WHEN kind IN ('function', 'method') THEN 1.0D ELSE 0.65D END",
    "edit_distance": "(a STRING, b STRING) RETURNS INT RETURN levenshtein(a, b)",
    "body_hash": r"(t STRING) RETURNS STRING RETURN sha2(regexp_replace(t, '(?:\\n[ \\t\\r]*(?:(?://|#|--|;)[^\\n]*|\\*/|/\\*[^\\n]*)?)+\\s*$', ''), 256)",
}


@F.pandas_udf(T.StringType())
def expand_concepts(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(vectors.expand_concepts)


@F.pandas_udf(T.ArrayType(T.StringType()))
def module_candidates(file: pd.Series, module: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([chunks.candidates(f or "", m or "", lang or "") for f, m, lang in zip(file, module, language)])


@F.udtf(returnType="fact string, kind string, name string, caller string, line_start int, line_end int, byte_start bigint, byte_end bigint, excerpt string")
class ExtractFacts:
    """``SELECT * FROM extract_facts(path, language, content)``: the facts of one file."""

    def eval(self, path: str, language: str, content: str) -> Iterator[tuple]:
        if language is not None and content is not None:
            yield from extract.facts(content, language)


@F.udtf(returnType="line_start int, line_end int, excerpt string, captures map<string,string>")
class MatchPattern:
    """``SELECT * FROM match_pattern(path, language, content, pattern)``: the matches in one file."""

    def eval(self, path: str, language: str, content: str, text: str) -> Iterator[tuple]:
        want = pattern(text) if text else None
        if want is None or language is None or content is None:
            return
        for a, b, captures in extract.matches(content, language, want):
            yield content.count("\n", 0, a) + 1, content.count("\n", 0, max(a, b - 1)) + 1, extract.excerpt(content[a:b]), extract.named(text, captures)


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session's SQL; returns their names."""
    for name, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    python = {"embed_hashed": vectors.embed_hashed, "expand_concepts": expand_concepts, "porter": lexical.porter, "module_candidates": module_candidates}
    for name, f in python.items():
        spark.udf.register(name, f)
    spark.udtf.register("extract_facts", ExtractFacts)
    spark.udtf.register("match_pattern", MatchPattern)
    return sorted([*SQL, *python, "extract_facts", "match_pattern"])
