"""Query grammar, intent and term rules (driver side, no Spark)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MODES = ("callers", "defs", "imports", "pattern", "literal", "regex", "word")
MAX_QUERY, MAX_GLOB, DEFAULT_LIMIT, MAX_LIMIT = 4096, 1024, 16, 1000
# Words that say nothing about what is sought (fixed values).
STOP = frozenset("a an and are at be by do does for from how in into is it of on or that the this to what when where which who why with".split())
# Marks that make a query structural (fixed values).
STRUCTURAL = ("{", ";", "=>", "->", "($", "$_", "$$")


class QueryError(ValueError):
    """A query that cannot be answered."""


@dataclass(frozen=True)
class Query:
    raw: str
    mode: str
    target: str
    terms: tuple[str, ...] = field(default=())

    @property
    def intent(self) -> str:
        return classify(self.raw)


@dataclass(frozen=True)
class Conjunction:
    left: Query
    right: Query
    negated: bool

    @property
    def scope(self) -> str:
        """Spans are compared only between a pattern and call edges, files otherwise."""
        return "span" if {self.left.mode, self.right.mode} == {"pattern", "callers"} else "file"


def camel(word: str) -> list[str]:
    return re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+|[^\W\da-zA-Z]+|\d+", word)


def scoring_terms(text: str) -> tuple[str, ...]:
    """Lower-case words, their underscore and camel-case parts, sorted, without stop words."""
    found: set[str] = set()
    for word in re.split(r"[^\w:]+", text):
        if not word:
            continue
        found.add(word.lower())
        pieces = [p for p in re.split(r"[_:]+", word) if p]
        if len(pieces) > 1:
            found.update(p.lower() for p in pieces)
        for piece in pieces:
            found.update(p.lower() for p in camel(piece) if len(p) > 1)
    kept = found - STOP
    return tuple(sorted(kept or found))


def parse(raw: str) -> Query:
    """Split a mode prefix off; anything else, whatever it holds, is free text."""
    if len(raw) > MAX_QUERY:
        raise QueryError(f"a query has at most {MAX_QUERY} characters")
    text = raw.strip()
    head, colon, rest = text.partition(":")
    if colon and head in MODES:
        target = rest.strip()
        if head in ("pattern", "literal", "regex"):
            terms: tuple[str, ...] = (target,) if target else ()
        elif head == "word":
            terms = (target.lower(),) if target else ()
        else:
            terms = scoring_terms(target) if target else ()
        return Query(raw, head, target, terms)
    if len(text) > 2 and text[0] == text[-1] == '"' and '"' not in text[1:-1]:
        return Query(raw, "literal", text[1:-1], (text[1:-1],))
    return Query(raw, "hybrid", text, scoring_terms(text))


def parse_conjunction(raw: str) -> Conjunction | None:
    """``A AND B`` or ``A AND NOT B`` of two prefixed channels; otherwise None."""
    sides = raw.split(" AND ")
    if len(sides) != 2:
        return None
    right = sides[1].strip()
    negated = bool(re.match(r"(?:NOT|not)\s+", right))
    right = re.sub(r"^(?:NOT|not)\s+", "", right)
    out = []
    for side in (sides[0].strip(), right):
        if m := re.fullmatch(r'semantic:"(.+)"', side):
            out.append(Query(side, "semantic", m.group(1), scoring_terms(m.group(1))))
            continue
        q = parse(side)
        if q.mode not in MODES or not q.target:
            return None
        out.append(q)
    return Conjunction(out[0], out[1], negated)


def looks_like_code(text: str) -> bool:
    words = text.split()
    return 0 < len(words) <= 3 and any("_" in w or "::" in w or "." in w.strip(".") or re.search(r"[a-z][A-Z]", w) or re.fullmatch(r"[A-Z][A-Z0-9]{2,}", w) for w in words)


def classify(raw: str) -> str:
    """literal, structural, symbol or conceptual."""
    text = raw.strip()
    if len(text) > 1 and text[0] in "\"'" and text[-1] == text[0]:
        return "literal"
    if any(m in text for m in STRUCTURAL):
        return "structural"
    words = text.split()
    if 0 < len(words) <= 2 and any("_" in w or "::" in w or re.search(r"[a-z][A-Z]", w) or re.match(r"[A-Z][a-z]", w) for w in words):
        return "symbol"
    return "conceptual"


def primary_symbol(text: str, terms: tuple[str, ...]) -> str | None:
    """The first cased word that is a term, else the first term that looks like a name."""
    for word in re.split(r"[^\w:]+", text):
        if word and word != word.lower() and word.lower() in terms:
            return word
    return next((t for t in terms if "_" in t or len(t) > 3), None)


def limit(n: int | None) -> int:
    return DEFAULT_LIMIT if not n else max(1, min(MAX_LIMIT, n))


def glob_regex(glob: str) -> str:
    """An anchored expression: ``**/`` any prefix, ``*`` and ``**`` anything, ``?`` one character."""
    if not glob or len(glob) > MAX_GLOB or re.search(r"[\x00-\x1f]", glob):
        raise QueryError("empty, too long or unprintable file pattern")
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i] == "*":
            out, i = out + ".*", i + (2 if glob.startswith("**", i) else 1)
        else:
            out, i = out + ("." if glob[i] == "?" else re.escape(glob[i])), i + 1
    return f"^{out}$"


def required_literal(pattern: str) -> str | None:
    """A run of at least three characters that every match of ``pattern`` holds, if easily seen."""
    if re.search(r"\(\?|\||[?*]|\{0|\\[xupP]", pattern):
        return None
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        nxt = pattern[i + 1 : i + 2]
        if c == "\\":
            if nxt.isalnum():
                runs.append(run)
                run = ""
            else:
                run += nxt
            i += 2
            continue
        if c == "[":
            runs.append(run)
            run = ""
            i = pattern.find("]", i + 2) + 1 or len(pattern)
            continue
        if c in ".^$()":
            runs.append(run)
            run = ""
        elif c in "+{":
            runs.append(run)
            run = ""
            if c == "{":
                i = pattern.find("}", i)
        else:
            run += c
        i += 1
    best = max([*runs, run], key=len)
    return best if len(best) >= 3 else None


DECLARATIONS = {"fn": "fn", "def": "def", "function": "function", "func": "fn", "class": "class", "struct": "struct", "interface": "interface", "type": "type"}


@dataclass(frozen=True)
class Pattern:
    """A structural pattern: what it looks for, its name or call path, arguments and body."""

    kind: str  # ident, function, class, call, if
    name: str | None = None  # None: any
    path: tuple[str | None, ...] = ()
    args: int | None = None  # None: any number
    body: str = "none"  # none, empty, one, any


def _arity(inside: str) -> int | None:
    inside = inside.strip()
    if inside in ("$$$", "$$") or re.fullmatch(r"\$\$\$\w*", inside):
        return None
    return 0 if not inside else inside.count(",") + 1


def _body(text: str) -> str:
    text = text.strip()
    if not text:
        return "none"
    inner = text.strip("{}:").strip()
    if not inner:
        return "empty" if text.startswith("{") else "any"
    return "any" if inner.startswith("$$$") or inner == ".." else "one" if re.fullmatch(r"\$\w+;?", inner) else "other"


def _name(text: str) -> str | None:
    return None if text.startswith("$") else text


def pattern(text: str) -> Pattern | None:
    """Read a structural pattern; None if it has a shape that is not supported."""
    text = text.strip()
    if m := re.match(r"(fn|def|function|func)\s+(\$?\w+)\s*(?:\(([^)]*)\))?\s*(.*)$", text, re.DOTALL):
        body = _body(m.group(4))
        return None if body == "other" else Pattern("function", _name(m.group(2)), args=None if m.group(3) is None else _arity(m.group(3)), body=body)
    if m := re.match(r"(class|struct|interface|type)\s+(\$?\w+)\s*(.*)$", text, re.DOTALL):
        return Pattern(m.group(1), _name(m.group(2)), body=_body(m.group(3))) if _body(m.group(3)) in ("none", "any") else None
    if m := re.match(r"if\s*(?:\(\s*\$\w+\s*\)|\$\w+)\s*(\{.*\}|:.*)$", text, re.DOTALL):
        body = _body(m.group(1))
        return None if body == "other" else Pattern("if", body=body)
    if m := re.match(r"((?:\$?\w+)(?:(?:\.|::)\$?\w+)*)\(([^()]*)\);?$", text):
        return Pattern("call", path=tuple(_name(p) for p in re.split(r"\.|::", m.group(1))), args=_arity(m.group(2)))
    if "$" not in text and re.fullmatch(r"[\w:]+", text):
        return Pattern("ident", text)
    return None


def signatures(text: str) -> tuple[str, ...]:
    """The signatures under which the index holds what ``text`` asks for (none: not indexed)."""
    p = pattern(text)
    if "{" in text or p is None:
        return ()
    if p.kind == "ident":
        return (text,)
    if p.kind == "call" and p.args is None and all(p.path):
        return (f"call:{'.'.join(x for x in p.path if x)}", f"call-name:{p.path[-1]}") if len(p.path) == 1 else (f"call:{'.'.join(x for x in p.path if x)}",)
    if p.kind not in ("call", "if") and p.name and p.args is None:
        prefix = DECLARATIONS.get(text.split()[0], text.split()[0])
        return (f"decl:{prefix}:{p.name}",)
    return ()


def term_signatures(term: str) -> tuple[str, ...]:
    return (f"call-name:{term}", f"call:{term}", f"decl:fn:{term}", f"decl:def:{term}", f"decl:function:{term}", term)
