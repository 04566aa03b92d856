"""A tree of files as a table: scan, ignore rules, language, hash; and an overlay of compiler facts."""

from __future__ import annotations

import re
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftspark.sources import files as store

MAX_BYTES = 64 << 20
EXTENSIONS = {
    "py": "python", "pyi": "python", "rs": "rust", "go": "go", "java": "java", "cs": "csharp", "rb": "ruby", "swift": "swift", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "kt": "kotlin", "kts": "kotlin", "php": "php",
}
TEXTS = ("md", "txt", "json", "toml", "yaml", "yml", "html", "css", "sh")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([A-Za-z0-9]+)$", 1))


def detect(path: Column, content: Column) -> Column:
    """Language by extension, else by what the content begins with."""
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    head = F.ltrim(content)
    sniffed = F.when(head.startswith("<?php"), "php").when(head.rlike(r"^#!.*\bpython"), "python").when(head.rlike(r"^#!.*\bruby"), "ruby").when(head.rlike(r"^#!.*\bnode"), "javascript").when(head.startswith("package "), "go")
    return F.coalesce(F.element_at(known, extension(path)), sniffed)


class Ignore:
    """Layered ignore files: later rules win, ``!`` takes back, an ignored folder hides all below it."""

    def __init__(self, files: dict[str, str]):
        self.rules = []
        for folder in sorted(files, key=lambda f: (f.count("/"), f)):
            for line in files[folder].splitlines():
                line = line.rstrip()
                if not line or line.startswith("#"):
                    continue
                negate, line = line.startswith("!"), line.lstrip("!")
                only_dir, line = line.endswith("/"), line.rstrip("/")
                anchored, line = "/" in line, line.lstrip("/")
                body = re.escape(line).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
                base = re.escape(folder.rstrip("/") + "/") if folder.rstrip("/") else ""
                self.rules.append((re.compile(f"^{base}{'' if anchored else '(?:.*/)?'}{body}$"), only_dir, negate))

    def __call__(self, path: str) -> bool:
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            sub, folder, hidden = "/".join(parts[:k]), k < len(parts), False
            for rule, only_dir, negate in self.rules:
                if (folder or not only_dir) and rule.match(sub):
                    hidden = not negate
            if hidden:
                return True
        return False


def ignore_files(spark: SparkSession, root: str, name: str = ".gitignore") -> dict[str, str]:
    """The ignore files of a tree by folder; their number is that of the tree's folders at most, and they are small."""
    return {f.rpartition("/")[0]: store.read_text(spark, f"{root}/{f}") for f in store.find(spark, root, name)}


def gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Judged queries and judged edges of a JSON file: ``(name, query, k, gold_id, file, symbol)``, ``(name, query, k, file, caller, callee, line)``.

    A file with neither is an error.
    """
    ref = "array<struct<file:string,symbol:string,caller:string,callee:string,line:int>>"
    one = f"array<struct<name:string,query:string,k:int,relevant:{ref}>>"
    raw = spark.read.schema(f"corpus string, queries {one}, graph_edges {one}").option("multiLine", "true").json(path)
    flat = lambda c: raw.select(F.inline(c)).select("name", "query", "k", F.posexplode("relevant").alias("gold_id", "r"))
    queries = flat("queries").select("name", "query", "k", "gold_id", "r.file", "r.symbol")
    edges = flat("graph_edges").select("name", "query", "k", "r.file", "r.caller", "r.callee", "r.line")
    if queries.isEmpty() and edges.isEmpty():
        raise ValueError("the file holds no judged query and no judged edge")
    return queries, edges


def tree(spark: SparkSession, root: str, ignores: dict[str, str] | None = None) -> DataFrame:
    """``path, language, content, content_hash, mtime`` of the text files below ``root``.

    Without ``ignores`` the tree's own ignore files are read.
    Hidden files, unknown extensions, ignored paths, files over the size cap and files that
    are not UTF-8 are left out; the cap is applied before a content is read.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = str(Path(root).resolve()).rstrip("/") + "/"
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(base), "")
    rows = raw.filter(F.col("length") <= MAX_BYTES).select(rel.alias("path"), "content", F.col("modificationTime").alias("mtime"))
    rows = rows.filter(extension(F.col("path")).isin(*EXTENSIONS, *TEXTS) & ~F.col("path").rlike(r"(^|/)\."))
    ignores = ignore_files(spark, root) if ignores is None else ignores
    hidden = Ignore(ignores)

    @F.pandas_udf(T.BooleanType())
    def ignored(paths: pd.Series) -> pd.Series:
        return paths.map(hidden)

    if ignores:
        rows = rows.filter(~ignored("path"))
    text = rows.filter(F.is_valid_utf8(F.col("content").cast("string"))).withColumn("content", F.col("content").cast("string")).filter(~F.col("content").contains("\0"))
    return text.select("path", detect(F.col("path"), F.col("content")).alias("language"), "content", F.sha2("content", 256).alias("content_hash"), "mtime")


def buffer(spark: SparkSession, path: str, content: str) -> DataFrame:
    """One unsaved text as a corpus."""
    row = spark.createDataFrame([(path, content)], "path string, content string")
    return row.select("path", detect(F.col("path"), F.col("content")).alias("language"), "content", F.sha2("content", 256).alias("content_hash"))


SCIP = "struct<documents:array<struct<relative_path:string,relativePath:string,occurrences:array<struct<symbol:string,symbol_roles:int,symbolRoles:int,range:array<int>>>>>>"


def scip(spark: SparkSession, text: str | None) -> tuple[DataFrame, str | None]:
    """``path, line_no, name, is_def`` of a compiler index; a reason instead of an error where it is unusable."""
    empty = spark.createDataFrame([], "path string, line_no int, name string, is_def boolean")
    if text is None:
        return empty, "missing"
    if len(text) > MAX_BYTES:
        return empty, "too large"
    parsed = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", SCIP).alias("j"))
    if parsed.filter("j.documents IS NOT NULL").isEmpty():
        return empty, "malformed"
    d = parsed.select(F.explode("j.documents").alias("d")).select(F.coalesce("d.relative_path", "d.relativePath").alias("path"), F.explode("d.occurrences").alias("o"))
    name = F.regexp_extract("o.symbol", r"([A-Za-z_]\w*)\W*$", 1)
    path = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^\./", "")
    roles = F.coalesce("o.symbol_roles", "o.symbolRoles", F.lit(0))
    return d.select(path.alias("path"), (F.element_at("o.range", 1) + 1).alias("line_no"), name.alias("name"), (roles.bitwiseAND(1) == 1).alias("is_def")).filter("name <> ''"), None
