"""Semantic chunks: their text, their fields, and where an import leads."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered() -> Column:
    """The text of a chunk that is embedded: the body first, then what it is, says, and is called by."""
    part = lambda label, c: F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(label + ": "), c))
    return F.concat_ws(
        "\n", part("excerpt", F.col("excerpt")), part("symbol", F.col("symbol_name")), part("kind", F.col("kind")), part("scope", F.col("scope")),
        part("doc", F.col("doc")), part("called_by", F.array_join(F.array_sort("callers"), " ")), part("calls", F.array_join(F.array_sort("callees"), " ")),
    )


def is_test(path: Column, name: Column, doc: Column) -> Column:
    """Does the chunk test or show something, by its path, name or documentation?"""
    by_path = F.lower(path).rlike(r"(?:^|/)(?:tests?|specs?|examples?|fixtures)(?:/|$)|[._-](?:test|spec)\.[a-z]+$")
    return by_path | F.coalesce(F.lower(name).rlike(r"^test|(?:_|^)test$"), F.lit(False)) | F.coalesce(F.lower(doc).contains("example"), F.lit(False))


def fields(chunks: DataFrame) -> DataFrame:
    """``chunk_id`` and the five field texts; a field without text is null."""
    some = lambda c: F.when(F.length(F.trim(c)) > 0, c)
    graph = F.concat_ws(" ", F.array_join(F.array_sort("callers"), " "), F.array_join(F.array_sort("callees"), " "))
    shows = is_test(F.col("path"), F.col("symbol_name"), F.col("doc"))
    return chunks.select("chunk_id", some(F.col("symbol_name")).alias("name"), some(F.col("doc")).alias("docs"), some(F.col("excerpt")).alias("body"), some(graph).alias("graph"), F.when(shows, some(F.col("excerpt"))).alias("tests_examples"))


def structure_hash(facts: DataFrame) -> DataFrame:
    """One hash per file over all of its derived rows: equal hashes need no new extraction."""
    row = F.to_json(F.struct(*[c for c in sorted(facts.columns) if c != "path"]))
    return facts.groupBy("path").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.sha2(row, 256)))), 256).alias("structure"))


def _normal(path: str) -> str:
    out: list[str] = []
    for p in path.split("/"):
        if p == "..":
            if out:
                out.pop()
        elif p not in ("", "."):
            out.append(p)
    return "/".join(out)


def candidates(path: str, module: str, language: str) -> list[str]:
    """The files that an import could mean, most likely first."""
    here = path.rsplit("/", 1)[0] if "/" in path else ""
    if language in ("javascript", "typescript"):
        if not module.startswith("."):
            return []
        base = _normal(f"{here}/{module}")
        stem = re.sub(r"\.(?:js|jsx|mjs|ts|tsx)$", "", base)
        return list(dict.fromkeys([base, *[stem + e for e in (".ts", ".tsx", ".js", ".jsx", ".mjs")], *[f"{base}/index{e}" for e in (".ts", ".tsx", ".js")]]))
    if language == "python":
        dots = len(module) - len(module.lstrip("."))
        name = module.lstrip(".").replace(".", "/")
        base = _normal(here + "/.." * (dots - 1) + "/" + name) if dots else name
        return [f"{base}.py", f"{base}/__init__.py"] if base else [_normal(f"{here}/__init__.py")]
    if language == "rust":
        name = re.sub(r"^(?:crate|self|super)(?:::|/)", "", module).replace("::", "/")
        roots = ["src", here] if module.startswith("crate") else [here, "src"]
        parts = name.split("/")
        return [_normal(f"{r}/{'/'.join(parts[:n])}{e}") for r in roots for n in range(len(parts), 0, -1) for e in (".rs", "/mod.rs")]
    if language in ("java", "kotlin"):
        name = module.replace(".", "/")
        return [f"{r}{name}{e}" for r in ("", "src/main/java/", "src/main/kotlin/", "src/") for e in (".java", ".kt")]
    if language in ("c", "cpp"):
        return list(dict.fromkeys([_normal(f"{here}/{module}"), _normal(module), _normal(f"include/{module}")]))
    if language == "ruby":
        return [_normal(f"{r}/{module}.rb") for r in (here, "lib", "")]
    if language == "php":
        return [module.replace("\\", "/") + ".php", "src/" + module.replace("\\", "/") + ".php"]
    return []


def resolve_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``path, line_no, module, target``: the first candidate that is an indexed file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, n, m, c, k) for p, lang, n, m in zip(f["path"], f["language"], f["line_no"], f["module"]) for k, c in enumerate(candidates(p, m, lang or ""))]
            if rows:
                yield pd.DataFrame(rows, columns=["path", "line_no", "module", "target", "rank"])

    wanted = edges.filter("module IS NOT NULL").select("path", "language", "line_no", "module").mapInPandas(run, "path string, line_no int, module string, target string, rank int")
    known = wanted.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return known.groupBy("path", "line_no", "module").agg(F.min(F.struct("rank", "target")).alias("b")).select("path", "line_no", "module", F.col("b.target").alias("target"))
