"""The fact tables of an indexed corpus, read from the data folder.

A file delivered twice counts once (its latest delivery), as does a line or a symbol.
Repeats are equal in every column, so they are removed by all columns: a filter on any of
them then moves below the removal and to the scan, and only what it leaves is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.sources.tables import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Spellings of language names (fixed values).
ALIASES = {"py": "python", "rs": "rust", "golang": "go", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "rb": "ruby", "c++": "cpp", "cc": "cpp", "c#": "csharp", "cs": "csharp", "kt": "kotlin"}


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only, as names are compared."""
    return F.translate(c, UPPER, LOWER)


def language(c: Column) -> Column:
    """The one name of a language; null stays null."""
    known = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    low = ascii_lower(F.trim(c))
    return F.coalesce(F.element_at(known, low), low)


def path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^\./", "")


def files(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "files").groupBy("file_id").agg(F.max(F.struct("indexed_at", "path", "language", "repo", "content_hash")).alias("f"))
    return rows.select("file_id", path(F.col("f.path")).alias("path"), language(F.col("f.language")).alias("language"), "f.repo", "f.content_hash")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "source_lines").select("file_id", "line_no", "content").distinct()
    return once.join(files(spark, folder).select("file_id", "path", "language"), "file_id")


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """Whole files: ``path, language, content``, the lines joined by line feeds (one shuffle, by file)."""
    line = F.struct("line_no", "content")
    text = F.array_join(F.transform(F.array_sort(F.collect_set(line)), lambda x: x.content), "\n")
    whole = table(spark, folder, "source_lines").filter("content IS NOT NULL").groupBy("file_id").agg(text.alias("content"))
    return whole.join(files(spark, folder).select("file_id", "path", "language"), "file_id").select("path", "language", "content")


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "symbols").distinct()
    return once.join(files(spark, folder).select("file_id", "path", "language"), "file_id")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "semantic_chunks").distinct()
    return once.join(files(spark, folder).select("file_id", "path", "language"), "file_id")


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """Call edges: one row per function chunk and callee."""
    rows = chunks(spark, folder).filter("kind IN ('function', 'method')")
    return rows.select("file_id", "path", "language", F.col("symbol_name").alias("caller"), F.explode("callees").alias("callee"), F.col("line_start").alias("line_no"), "chunk_id").distinct()


def hits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_agent_hits").dropDuplicates(["hit_id"])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files: ``path, language, text``."""
    rows = table(spark, folder, "documents").dropDuplicates(["doc_id"])
    return rows.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.lower("lang").alias("language"), "text")


# The same tables in SQL, for the checks.
SQL = """f AS (SELECT file_id, regexp_replace(replace(path, '\\', '/'), '^\\./', '') AS path, repo, content_hash,
  CASE lower(trim(language)) WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'golang' THEN 'go' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'rb' THEN 'ruby' WHEN 'c++' THEN 'cpp' WHEN 'cc' THEN 'cpp' WHEN 'c#' THEN 'csharp' WHEN 'cs' THEN 'csharp' WHEN 'kt' THEN 'kotlin' ELSE lower(trim(language)) END AS language
  FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY indexed_at DESC) AS rn FROM files) WHERE rn = 1),
l AS (SELECT f.file_id, f.path, f.language, x.line_no, x.content FROM (SELECT DISTINCT file_id, line_no, content FROM source_lines) x JOIN f ON f.file_id = x.file_id),
s AS (SELECT f.path, f.language, x.* FROM (SELECT DISTINCT * FROM symbols) x JOIN f ON f.file_id = x.file_id),
k AS (SELECT f.path, f.language, x.* FROM (SELECT DISTINCT * FROM semantic_chunks) x JOIN f ON f.file_id = x.file_id),
e AS (SELECT DISTINCT file_id, path, language, symbol_name AS caller, unnest(callees) AS callee, line_start AS line_no, chunk_id FROM k WHERE kind IN ('function', 'method')),
h AS (SELECT DISTINCT * FROM search_agent_hits)"""
