"""From files to facts: symbols, calls, imports and pattern nodes; structural matching and rewriting.

Python is read by its own parser. The other languages go through one table-driven
scanner: comments and strings are masked, declarations are found by keyword, bodies by
matching braces or ``end``. It is an approximation of a grammar, but nothing is taken
from comments or strings, and a call's caller is the nearest function around it or
``<module>``. Another extractor can be registered per language in ``EXTRACTORS``.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.plans.query import Pattern, pattern
from siftspark.sources import files as store

SCHEMA = "path string, language string, fact string, kind string, name string, caller string, line_start int, line_end int, byte_start long, byte_end long, excerpt string"
DECLARED = {
    "rust": (r"\bfn\s+(\w+)", r"\b(?:struct|enum|trait|impl)\s+(\w+)", r"\buse\s+([\w:]+)"),
    "go": (r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)", r"\btype\s+(\w+)\s+(?:struct|interface)", r"\bimport\s+\"([^\"]+)\""),
    "javascript": (r"\bfunction\s*\*?\s*(\w+)|^\s*(?:static\s+|async\s+|get\s+|set\s+)*(\w+)\s*\([^()]*\)\s*\{", r"\bclass\s+(\w+)", r"\bfrom\s+[\"']([^\"']+)|\brequire\([\"']([^\"']+)"),
    "java": (r"(?:[\w<>\[\],.]+\s+)+(\w+)\s*\([^()]*\)\s*(?:throws\s+[\w.,\s]+)?\{", r"\b(?:class|interface|enum|record)\s+(\w+)", r"\bimport\s+(?:static\s+)?([\w.*]+)"),
    "csharp": (r"(?:[\w<>\[\],.?]+\s+)+(\w+)\s*\([^()]*\)\s*\{", r"\b(?:class|interface|enum|record|struct)\s+(\w+)", r"\busing\s+([\w.]+)\s*;"),
    "c": (r"^[A-Za-z_][\w\s*&:<>,]*?\b(\w+)\s*\([^()]*\)\s*\{", r"\b(?:struct|enum|union|class)\s+(\w+)", r"#\s*include\s*[\"<]([^\">]+)"),
    "kotlin": (r"\bfun\s+(?:[\w.<>]+\.)?(\w+)", r"\b(?:class|interface|object)\s+(\w+)", r"\bimport\s+([\w.*]+)"),
    "swift": (r"\bfunc\s+(\w+)", r"\b(?:class|struct|enum|protocol|extension)\s+(\w+)", r"\bimport\s+(\w+)"),
    "php": (r"\bfunction\s+&?(\w+)", r"\b(?:class|interface|trait)\s+(\w+)", r"\buse\s+([\w\\]+)"),
    "ruby": (r"\bdef\s+(?:self\.)?(\w+[?!=]?)", r"\b(?:class|module)\s+(\w+)", r"\brequire(?:_relative)?\s+[\"']([^\"']+)"),
}
DECLARED["typescript"], DECLARED["cpp"] = (DECLARED["javascript"][0].replace(r"\s*\{", r"\s*(?::[^{};]+)?\{"), r"\b(?:class|interface|enum)\s+(\w+)", DECLARED["javascript"][2]), DECLARED["c"]
NOT_CALLS = frozenset("if for while switch catch return sizeof function fn func def foreach match when elif else and or not in assert print class new await typeof super guard".split())
PREFIX = {"rust": "fn", "go": "fn", "swift": "fn", "kotlin": "fn", "python": "def", "ruby": "def"}


# Symbol kinds and declaration prefixes of type-like declarations, by the word that declares them (fixed values).
KINDS = {"interface": "interface", "trait": "interface", "protocol": "interface", "enum": "enum", "type": "type", "union": "type"}
FORMS = {"struct": "struct", "enum": "enum", "interface": "interface", "trait": "interface", "protocol": "interface"}


@dataclass
class Node:
    kind: str  # function, method, class, call, import, ident, if
    name: str
    start: int
    end: int
    args: int = -1
    body: int = -1  # statements, -1 unknown
    path: tuple[str, ...] = ()
    form: str = ""  # the word that declares it: class, struct, enum, interface and so on
    inner: tuple[int, int] = (0, 0)  # the arguments of a call or declaration
    block: tuple[int, int] = (0, 0)  # the body


def mask(text: str, language: str) -> str:
    """The text with comments and strings blanked, line breaks kept."""
    hash_ = language in ("python", "ruby", "php")
    parts = [r"\"(?:[^\"\\\n]|\\.)*\"", r"'(?:[^'\\\n]|\\.)*'" if language != "rust" else r"'(?:[^'\\]|\\.)'", r"`[^`]*`"]
    parts += [r"/\*[\s\S]*?\*/", r"//[^\n]*"] if language not in ("python", "ruby") else []
    parts += [r"#[^\n]*"] if hash_ else []
    blank = lambda m: m.group()[0] + re.sub(r"[^\n]", " ", m.group()[1:-1]) + m.group()[-1] if m.group()[0] in "\"'`" else re.sub(r"[^\n]", " ", m.group())
    return re.sub("|".join(parts), blank, text)


def _close(masked: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return len(masked)


def _end_keyword(masked: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"(?m)^\s*(?:def|class|module|if|unless|case|begin|while|until)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|^\s*end\b").finditer(masked, at):
        depth += -1 if m.group().strip() == "end" else 1
        if depth == 0:
            return m.end()
    return len(masked)


def _count_args(inside: str) -> int:
    depth, n = 0, 1 if inside.strip() else 0
    for c in inside:
        depth += (c in "([{") - (c in ")]}")
        n += c == "," and depth == 0
    return n


def _statements(inside: str) -> int:
    flat, depth, out = "", 0, 0
    for c in inside:
        depth += c == "{"
        if not depth:
            flat += c
        depth -= c == "}"
        if c == "}" and not depth:
            out += 1
            flat += "\n"
    return out + len([s for s in re.split(r"[;\n]", flat) if s.strip() and s.strip() not in "{}"])


def scan(text: str, language: str) -> list[Node]:
    rules = DECLARED.get(language)
    if not rules:
        return []
    masked, out = mask(text, language), []
    named_at: set[int] = set()  # where the names of declared functions stand
    classes: list[Node] = []
    for m in re.finditer(rules[1], masked, re.MULTILINE):
        end = _end_keyword(masked, masked.rfind("\n", 0, m.start()) + 1) if language == "ruby" else _close(masked, m.end())
        form = re.search(r"\b(class|struct|enum|union|trait|interface|protocol|record|module|object|impl|extension|type)\b", m.group())
        form_ = "interface" if re.search(r"\binterface\b", m.group()) else "struct" if re.search(r"\bstruct\b", m.group()) else form.group(1) if form else "class"
        classes.append(Node("class", m.group(1), m.start(), end, form=form_))
    for m in re.finditer(rules[0], masked, re.MULTILINE):
        name = next((g for g in m.groups() if g), "")
        if not name or name in NOT_CALLS:
            continue
        line = masked.rfind("\n", 0, m.start()) + 1
        named_at.add(next(m.start(g) for g in range(1, (m.lastindex or 0) + 1) if m.group(g)))
        begin = m.start() + len(m.group()) - len(m.group().lstrip())
        open_ = masked.find("{", m.start())
        end = _end_keyword(masked, line) if language == "ruby" else _close(masked, m.start()) if open_ >= 0 else m.end()
        paren = masked.find("(", m.start(1) if m.group(1) else m.start())
        args = _count_args(masked[paren + 1 : masked.find(")", paren)]) if paren >= 0 else 0
        inside = masked[open_ + 1 : end - 1] if language != "ruby" and open_ >= 0 else masked[m.end() : end - 3]
        kind = "method" if any(c.start < m.start() < c.end for c in classes) else "function"
        stop = masked.find(")", paren) if paren >= 0 else -1
        out.append(Node(kind, name, begin, end, args, _statements(inside), inner=(paren + 1, stop) if stop > 0 else (0, 0), block=(open_ + 1, end - 1) if language != "ruby" and open_ >= 0 else (m.end(), max(m.end(), end - 3))))
    out += classes
    for m in re.finditer(r"(?<![\w$])((?:[A-Za-z_$][\w$]*(?:\.|::|->))*)([A-Za-z_$][\w$]*[!?]?)\s*\(", masked):
        before = masked[max(0, m.start() - 12) : m.start()]
        if m.group(2) in NOT_CALLS or re.search(r"\b(?:fn|func|fun|function|def)\s+(?:self\.)?$", before) or m.start(2) in named_at:
            continue
        depth, k = 0, m.end() - 1
        while k < len(masked):
            depth += (masked[k] == "(") - (masked[k] == ")")
            k += 1
            if not depth:
                break
        path = tuple(p for p in re.split(r"\.|::|->", m.group(1)) if p) + (m.group(2),)
        out.append(Node("call", m.group(2), m.start(), k, _count_args(masked[m.end() : k - 1]), path=path, inner=(m.end(), k - 1)))
    for m in re.finditer(r"\bif\b[^{\n]*\{", masked):
        end = _close(masked, m.start())
        out.append(Node("if", "if", m.start(), end, body=_statements(masked[m.end() : end - 1])))
    for m in re.finditer(rules[2], text, re.MULTILINE):
        module = next((g for g in m.groups() if g), "")
        if masked[m.start()] == text[m.start()]:
            out.append(Node("import", module, m.start(), m.end()))
    return out


def scan_python(text: str, language: str = "python") -> list[Node]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    starts = [0]
    for line in text.encode().split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    raw = text.encode()
    at = lambda line, col: len(raw[: starts[line - 1] + col].decode(errors="ignore"))
    out: list[Node] = []

    def visit(node: ast.AST, inside: bool) -> None:
        for child in ast.iter_child_nodes(node):
            span = (at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset)) if hasattr(child, "lineno") else (0, 0)
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                a = child.args
                n = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
                block = (at(child.body[0].lineno, child.body[0].col_offset), span[1])
                out.append(Node("method" if inside else "function", child.name, *span, n, len(child.body), block=block))
                visit(child, False)
                continue
            if isinstance(child, ast.ClassDef):
                out.append(Node("class", child.name, *span, form="class"))
                visit(child, True)
                continue
            if isinstance(child, ast.Call):
                path, f = [], child.func
                while isinstance(f, ast.Attribute):
                    path.append(f.attr)
                    f = f.value
                if isinstance(f, ast.Name):
                    path.append(f.id)
                if path:
                    inside = [*child.args, *[k.value for k in child.keywords]]
                    begin = at(child.func.end_lineno, child.func.end_col_offset)
                    out.append(Node("call", path[0], *span, len(inside), path=tuple(reversed(path)), inner=(min(begin + 1, span[1] - 1), span[1] - 1)))
            elif isinstance(child, ast.If):
                out.append(Node("if", "if", *span, body=len(child.body)))
            elif isinstance(child, ast.Import):
                out.extend(Node("import", a.name, *span) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append(Node("import", "." * child.level + (child.module or ""), *span))
            visit(child, inside)

    visit(tree, False)
    return out


EXTRACTORS: dict[str, Callable[[str, str], list[Node]]] = {"python": scan_python, **{k: scan for k in DECLARED}}


def nodes(text: str, language: str) -> list[Node]:
    run = EXTRACTORS.get(language)
    return run(text, language) if run else []


def excerpt(part: str) -> str:
    return part if part.count("\n") < 6 else part.split("\n", 1)[0]


def facts(text: str, language: str) -> list[tuple]:
    """``(fact, kind, name, caller, line_start, line_end, byte_start, byte_end, excerpt)``."""
    found = nodes(text, language)
    functions = [n for n in found if n.kind in ("function", "method")]
    line = lambda k: text.count("\n", 0, k) + 1
    out, seen = [], set()

    def add(fact: str, kind: str, name: str, caller: str | None, n: Node) -> None:
        key = (fact, name, line(n.start)) if fact == "pattern" else (fact, kind, name, n.start)
        if key not in seen:
            seen.add(key)
            out.append((fact, kind, name, caller, line(n.start), line(max(n.start, n.end - 1)), len(text[: n.start].encode()), len(text[: n.end].encode()), excerpt(text[n.start : n.end])))

    for n in found:
        around = [f for f in functions if f.start < n.start and n.end <= f.end]
        caller = min(around, key=lambda f: f.end - f.start).name if around else "<module>"
        if n.kind == "call":
            add("call", "call", n.name, caller, n)
            add("pattern", "call", f"call:{'.'.join(n.path)}", caller, n)
            add("pattern", "call", f"call-name:{n.name}", caller, n)
        elif n.kind == "import":
            add("import", "import", n.name, None, n)
        elif n.kind == "if":
            add("pattern", "if", "kind:if", caller, n)
        else:
            kind = KINDS.get(n.form, n.kind)
            add("symbol", kind, n.name, None, n)
            prefix = PREFIX.get(language, "function") if n.kind != "class" else FORMS.get(n.form, "class")
            add("pattern", n.kind, f"decl:{prefix}:{n.name}", None, n)
            add("pattern", n.kind, f"{prefix} {n.name}", None, n)
            add("pattern", n.kind, f"kind:{n.kind}", None, n)
            add("pattern", "ident", n.name, None, n)
    return out


def extract(sources: DataFrame) -> DataFrame:
    """All facts of ``path, language, content`` as tagged rows, one pass over the files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, lang, *x) for p, lang, t in zip(f["path"], f["language"], f["content"]) for x in facts(t, lang)]
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return sources.filter("content IS NOT NULL AND language IS NOT NULL").select("path", "language", "content").mapInPandas(run, SCHEMA)


def matches(text: str, language: str, want: Pattern) -> list[tuple[int, int, dict[str, str]]]:
    """``(start, end, captures)`` of the nodes that a structural pattern describes."""
    out = []
    for n in nodes(text, language):
        if want.kind == "ident":
            if n.name == want.name and n.kind in ("function", "method", "class", "call"):
                out.append((n.start, n.end, {"MATCH": text[n.start : n.end], "NAME": n.name}))
            continue
        if want.kind == "function":
            ok = n.kind in ("function", "method")
        elif want.kind in ("class", "struct", "interface", "type"):
            ok = n.kind == "class" and (want.kind == "class" or re.match(rf"\s*(?:pub\s+|export\s+)*{want.kind}\b", text[max(0, n.start - 12) : n.end]) is not None or want.kind in text[n.start : n.start + 12])
        else:
            ok = n.kind == want.kind
        if not ok:
            continue
        if want.kind == "call":
            if len(want.path) > 1:
                ok = len(n.path) == len(want.path) and all(w is None or w == p for w, p in zip(want.path, n.path))
            else:
                ok = want.path[0] is None or n.path[-1] == want.path[0]
        elif want.name is not None:
            ok = n.name == want.name
        if want.args is not None and n.args != want.args:
            ok = False
        if {"empty": n.body != 0, "one": n.body != 1}.get(want.body, False):
            ok = False
        if ok:
            held = {"MATCH": text[n.start : n.end], "NAME": n.name, "PATH": ".".join(n.path), "ARGS": text[n.inner[0] : n.inner[1]], "BODY": text[n.block[0] : n.block[1]]}
            out.append((n.start, n.end, held | {f"P{k}": p for k, p in enumerate(n.path)}))
    return out


def named(text: str, captures: dict[str, str]) -> dict[str, str]:
    """The captures also under the names that the pattern gives them: ``$X`` its name, ``$$$X`` arguments, then body."""
    out = dict(captures)
    head = text.split("(", 1)[0]
    for k, part in enumerate(re.split(r"\.|::|\s+", head)):
        if m := re.fullmatch(r"\$(\w+)", part):
            out.setdefault(m.group(1), captures.get(f"P{k}", captures["NAME"]) if "P1" in captures else captures["NAME"])
    for name, what in zip(re.findall(r"\$\$\$(\w+)", text), ("ARGS", "BODY") if "(" in text else ("BODY",)):
        out.setdefault(name, captures.get(what, ""))
    return out


def match_pattern(sources: DataFrame, text: str) -> DataFrame:
    """Matches of a structural pattern: ``path, line_start, line_end, excerpt, captures``.

    Files without a literal that the pattern needs are dropped before any is parsed. A
    shape that is not supported matches nothing.
    """
    want = pattern(text)
    schema = "path string, line_start int, line_end int, excerpt string, captures map<string,string>"
    if want is None:
        return sources.sparkSession.createDataFrame([], schema)
    need = [w for w in re.findall(r"(?<![\w$])[A-Za-z_]\w{2,}", text) if w not in ("function", "func", "def", "class", "struct", "interface", "type")]
    rows = sources.filter("content IS NOT NULL AND language IS NOT NULL")
    for w in need:
        rows = rows.filter(F.col("content").contains(w))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p, lang, t in zip(f["path"], f["language"], f["content"]):
                for a, b, captures in matches(t, lang, want):
                    out.append((p, t.count("\n", 0, a) + 1, t.count("\n", 0, max(a, b - 1)) + 1, excerpt(t[a:b]), named(text, captures)))
            if out:
                yield pd.DataFrame(out, columns=["path", "line_start", "line_end", "excerpt", "captures"])

    return rows.select("path", "language", "content").mapInPandas(run, schema)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def apply(spark: SparkSession, plan: DataFrame, root: str) -> int:
    """Write a rewrite plan below ``root``: all files or none.

    Every file is first compared with the text the plan was made from, then staged beside its
    target, and only when all are staged they are renamed into place; if one cannot be, those
    before it are put back. Returns the number of files written.
    """
    if not plan.filter("error IS NOT NULL").isEmpty():
        raise ValueError("the plan has files with overlapping matches")
    done: list[tuple[str, str]] = []
    rows = plan.select("path", "rewritten", "original")
    for r in rows.toLocalIterator():
        now = store.read_text(spark, f"{root}/{r['path']}")
        if now is None or digest(now) != r["original"]:
            raise ValueError(f"{r['path']} has changed since the plan was made")
    try:
        for r in rows.toLocalIterator():
            target = f"{root}/{r['path']}"
            done.append((target, store.read_text(spark, target)))
            store.write_text(spark, target, r["rewritten"])
    except Exception:
        for target, before in done:
            store.write_text(spark, target, before)
        raise
    return len(done)


def codemod(sources: DataFrame, text: str, replacement: str) -> DataFrame:
    """The rewrite plan ``path, edits, rewritten``: each match replaced, ``$NAME`` and ``$MATCH`` filled in.

    Overlapping matches are an error of that file (``error`` says so); files that would not
    change give no row. Nothing is written.
    """
    want = pattern(text)
    schema = "path string, edits int, rewritten string, error string, original string"
    if want is None:
        return sources.sparkSession.createDataFrame([], schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p, lang, t in zip(f["path"], f["language"], f["content"]):
                found = sorted(matches(t, lang, want), key=lambda x: x[:2])
                if any(a[1] > b[0] for a, b in zip(found, found[1:])):
                    out.append((p, 0, None, "overlapping matches", digest(t)))
                    continue
                new, last, n = "", 0, 0
                for a, b, captures in found:
                    held = named(text, captures)
                    put = re.sub(r"\$\$\$(\w+)|\$\$|\$(\w+)", lambda m: "$" if m.group() == "$$" else held.get(m.group(1) or m.group(2), m.group()), replacement)
                    n += put != t[a:b]
                    new, last = new + t[last:a] + put, b
                if n:
                    out.append((p, n, new + t[last:], None, digest(t)))
            if out:
                yield pd.DataFrame(out, columns=["path", "edits", "rewritten", "error", "original"])

    return sources.filter("content IS NOT NULL AND language IS NOT NULL").select("path", "language", "content").mapInPandas(run, schema)


