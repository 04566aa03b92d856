"""Problem 6: functions paired with their documentation.

The signature of a function is found by regular expressions over its first lines, its
body is delimited by a stack (indentation, braces or end keywords, as the language has
it); what stands from the signature to the body's end is the code of the pair. Comments
are attached by line distance: those of the ``doc`` column, those at most one blank line
above the signature in the excerpt, and the first string or block comment of the body when
nothing but blank lines is between it and the signature's last line, however long the
signature is. The attached text is cleaned
of comment marks and judged sentence by sentence; a pair is kept if anything remains
that is not a placeholder, the mere name, a rule, a tool mark, a tag without text,
disabled code or a licence notice.

Everything happens where a row is read; only kept rows are shuffled, to drop chunks
that were delivered twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.sources.tables import table

SIGNATURE = re.compile(
    r"^\s*(?:(?:export|default|public|private|protected|internal|static|final|abstract|override|async|inline|virtual|extern|unsafe|open|suspend|pub(?:\([^)]*\))?|const)\s+)*"
    r"(?:(?:def|fn|func|fun|function|sub)\b\s*(?:\([^)]*\)\s*)?[&*]?\s*(?:self\.)?(?P<kw>[\w$]+[?!=]?)"
    r"|(?:constructor|init)\b|(?:[\w:<>,\[\]*&?.]+\s+)+[*&]*(?P<typed>[\w$~]+)\s*\(|(?P<bare>[\w$#]+)\s*\()"
)
_SKIP = re.compile(r"^\s*(?:@[\w.]+(?:\([^)]*\))?|#\[.*\]|\[[A-Z]\w*(?:\(.*\))?\])\s*$")
_COMMENT = re.compile(r"^\s*(?:///?|//!|#(?![\[!])|--|/\*|\*|\*/|;)")
_TRIPLE = re.compile(r"^\s*[rRuUbBfF]{0,2}(\"\"\"|''')")
_PLAIN = re.compile(r"^\s*[rRuU]?(\"|')((?:[^\\]|\\.)*?)\1\s*;?\s*$")
_TOOL = re.compile(
    r"(?i)^(?:nolint\w*|eslint[\w-]*|tslint[\w:-]*|jshint\b|jslint\b|noqa\b|type:\s*ignore|pylint:|flake8:|mypy:|pragma\b|rubocop:|ts-(?:ignore|nocheck|expect-error)|@ts-|istanbul\b|c8 ignore|prettier-ignore|clang-format\b|swiftlint:|ktlint|detekt|checkstyle|spotless|fmt:|yapf:|isort:|black:|go:\w+|\+build|region\b|endregion\b|cov(?:erage)?:|phpcs:|psalm-|phpstan-|@phpstan|@psalm|nosec|nosonar|suppress\w*|resharper|lint:|biome-ignore|shellcheck|sourcery|sonar)"
)
_PLACE = re.compile(
    r"(?i)^(?:todo|fixme|xxx|hack|tbd|wip|n/?a|none|null|nil|undocumented|missing|description|summary|docs?|documentation|comment|placeholder|lorem ipsum.*|to be (?:done|written|documented|completed)|no (?:description|documentation|docs)(?: (?:available|yet|provided))?|(?:function|method|class|short|brief|add|write|insert|your|a)?\s*(?:description|documentation|docs?|docstring|comment|summary)(?: (?:goes|here|of (?:the|this) (?:function|method)|text|to come|needed|missing|pending))*|auto-?generated(?: .*)?(?:stub|code|method|by .*)?|generated (?:stub|by .*)|see (?:above|below|super(?:class)?|base|parent)|same as above|as above|document (?:this|me)|fill (?:me )?in|self[- ]explanatory|work in progress|coming soon|not (?:yet )?documented|method stub|stub)$"
)
_MARK = re.compile(r"(?i)^(?:todo|fixme|xxx|hack|tbd|wip)\b(?:\s*\([^)]*\))?\s*[:\-.,]?\s*")
_LICENCE = re.compile(r"(?i)copyright|©|\(c\)\s*\d{4}|all rights reserved|licen[sc]ed? under|spdx-|licen[sc]e\b.*(?:file|terms|version|mit|apache|bsd|gpl)|permission is hereby granted|redistribution and use|without warrant|provided \"as is\"|use of this source|governed by|see the license|\blicence\b|\blicense\b")
_TAG = re.compile(r"(?i)^[@\\:]?(?:param(?:eter)?s?|arg(?:ument)?s?|returns?|rtype|type|throws?|raises?|exception|yields?|see|since|author|version|deprecated|inheritdoc|override|todo|internal|private|public|protected|hidden|ignore|api|module|memberof|class|static|async|function|method|name|template|typeparam|tparam|brief|details|note|example|link)\b")
_INHERIT = re.compile(r"(?i)\{?@?inherit-?doc\}?|\(non-javadoc\)")
_CODE = re.compile(r"[;{}]\s*$|^\s*(?:return|if|for|while|else|elif|try|except|import|from|let|var|const|def|fn|func|raise|throw|print|log\.\w+)\b.*(?:[;:{}()=]|\[\d)|^\s*[\w.$]+\s*(?:\+|-|\*|/)?=\s*\S|^\s*[\w.]+\([^)]*\)(?:\[\d+\])?\s*;?\s*$|^\s*return\s+[\w.]+;?\s*$|=>\s*$|^\s*(?:break|continue|pass)\s*;?\s*$|^\s*\$\w+")
_RULE = re.compile(r"^[\W_]*$", re.UNICODE)
_WORD = re.compile(r"[^\W\d_]+")
_PLAIN_WORD = re.compile(r"(?<!\S)[\"'(]?[^\W\d_]+[\"')]?[,.;:!?]?(?!\S)")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")


def body(lines: list[str], at: int) -> int:
    """The line after the body of the function whose signature stands at ``at``."""
    head = lines[at]
    pad = len(head) - len(head.lstrip())
    if re.match(r"^\s*(?:async\s+)?def\b", head):
        block = [i for i in range(at + 1, len(lines)) if lines[i].strip()]
        if any(re.match(r"^\s*end\b", lines[i]) and len(lines[i]) - len(lines[i].lstrip()) <= pad for i in block):
            depth = 0  # end keywords
            for i in range(at, len(lines)):
                depth += len(re.findall(r"^\s*(?:def|if|unless|while|until|case|begin|class|module|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$", lines[i]))
                depth -= bool(re.match(r"^\s*end\b", lines[i]))
                if depth <= 0:
                    return i + 1
            return len(lines)
        head_end = signature_end(lines, at, len(lines))
        return next((i for i in block if i >= head_end and len(lines[i]) - len(lines[i].lstrip()) <= pad), len(lines))
    depth, seen = 0, False
    text = re.sub(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", lambda m: "\n" * m.group().count("\n"), "\n".join(lines[at:])).split("\n")
    for i in range(at, len(lines)):
        for c in text[i - at]:
            if c == "{":
                depth, seen = depth + 1, True
            elif c == "}":
                depth -= 1
        if seen and depth <= 0 or not seen and lines[i].rstrip().endswith(";"):
            return i + 1
    return len(lines)


def signature(lines: list[str]) -> int | None:
    """The line of the first signature, behind comments and marks."""
    return next((i for i, x in enumerate(lines) if x.strip() and not _COMMENT.match(x) and not _SKIP.match(x) and SIGNATURE.match(x)), None)


def signature_end(lines: list[str], at: int, end: int) -> int:
    """The line after the signature that begins at ``at``: where its brackets are closed."""
    depth = 0
    for k in range(at, end):
        code = re.sub(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'", "", lines[k])
        depth += sum(code.count(c) for c in "([") - sum(code.count(c) for c in ")]")
        if depth <= 0:
            return k + 1
    return end


def code_of(excerpt: str | None) -> str | None:
    """The function alone: from its signature to the end of its body (the excerpt where no signature is seen)."""
    lines = re.split(r"\r\n|\r|\n", excerpt or "")
    at = signature(lines)
    return excerpt if at is None else "\n".join(lines[at : max(body(lines, at), signature_end(lines, at, len(lines)))]).rstrip()


def attached(doc: str | None, excerpt: str | None) -> str:
    """The documentation text of a definition: above it, and inside it."""
    parts = [doc] if doc and doc.strip() else []
    lines = re.split(r"\r\n|\r|\n", excerpt or "")
    at = signature(lines)
    if at is None:
        return "\n".join(parts)
    above, i = [], at - 1
    while i >= 0 and (_COMMENT.match(lines[i]) or _SKIP.match(lines[i]) or (not lines[i].strip() and i == at - 1)):
        if not _SKIP.match(lines[i]):
            above.append(lines[i])
        i -= 1
    if above:
        parts.append("\n".join(reversed(above)))
    end = max(body(lines, at), signature_end(lines, at, len(lines)))
    first = signature_end(lines, at, end)
    while first < end and (not lines[first].strip() or lines[first].strip() == "{"):
        first += 1
    if first >= end:
        return "\n".join(parts)
    if m := _TRIPLE.match(lines[first]):
        mark = m.group(1)
        text = "\n".join(lines[first:end])[m.end() :]
        parts.append(text.split(mark, 1)[0])
    elif m := _PLAIN.match(lines[first]):
        parts.append(m.group(2))
    elif lines[first].lstrip().startswith("/*"):  # a line comment there explains the next statement
        parts.append("\n".join(lines[first:end]).split("*/", 1)[0])
    return "\n".join(parts)


def clean(text: str) -> list[str]:
    """Lines of the comment without its marks."""
    out = []
    for line in re.split(r"\r\n|\r|\n", text):
        line = re.sub(r"^\s*(?:/\*+!?|\*+/|\*+(?!\S*\*)|//+[!/]?|#+|--+|;+|<!--|\"\"\"|''')?\s?", "", line.strip())
        line = re.sub(r"\s*(?:\*+/|-->|\"\"\"|''')\s*$", "", line)
        line = re.sub(r"^(?:[*#/]+\s*)+(?=\S)", "", line.strip())
        out.append(re.sub(r"</?(?:summary|remarks|para|p|inheritdoc|returns|c|code|b|i|br)\s*/?>", " ", line).strip())
    return out


def parts_of(name: str) -> list[str]:
    return [w.lower() for w in _CAMEL.findall(name or "")]


def tells(text: str, name: str | None = None) -> str:
    """What the documentation says, or '' if it says nothing."""
    own, kept = parts_of(name or ""), []
    units: list[str] = []
    for line in clean(text):
        for piece in re.split(r"(?<=\s)(?=[@\\](?:param|returns?|throws|raises|see|deprecated)\b|:(?:param|returns?|raises|rtype|type)\b)|^(?=[@:])", line):
            units += re.split(r"(?<=[.!?。！？।])(?:\s+|(?=[^\x00-\x7f]))", piece.strip())
    held = ""
    for unit in units:
        u = unit.strip()
        if not u:
            held = ""
            continue
        u = _INHERIT.sub(" ", u).strip()
        if _RULE.match(u) or _TOOL.match(u.lstrip("#/*@ ")) or _LICENCE.search(u):
            continue
        bare = u.strip(" .:;!-*#/\"'`")
        if _PLACE.match(bare):
            continue
        if _CODE.search(u) and not (len(_PLAIN_WORD.findall(u)) >= 5 and u[-1:] not in "{};"):
            continue
        if m := _MARK.match(u):  # an open task is no description
            continue
        if m := _TAG.match(u):
            rest = re.sub(r"^[\s:\-–.,]+", "", u[m.end() :])
            rest = re.sub(r"^\{[^}]*\}\s*|^\([^)]*\)\s*", "", rest)
            kind = m.group().lower().lstrip("@\\:")
            if kind.startswith(("param", "arg", "type", "throw", "raise", "exception", "tparam")):
                rest = re.sub(r"^(?:[\w$\[\]=.*&]+)\s*(?:\([^)]*\))?\s*[:\-–,]?\s*", "", rest, count=1)
            if u[:1] not in "@\\:" and not kind.startswith(("param", "arg", "type", "returns")) or (kind.startswith(("return", "yield")) and u[:1] not in "@\\:" and not re.match(r"^\w+\s*:", u)):
                rest = u if len(_WORD.findall(u)) > 1 else ""
            words = [w.lower() for w in _WORD.findall(rest)]
            if kind.startswith(("deprecated", "author", "since", "version", "see", "inherit", "override", "module", "memberof", "name", "function", "method", "class")) and u[:1] in "@\\":
                continue
            if len(words) < 2 and not re.search(r"[^\x00-\x7f]{4,}", rest):
                continue
            u = rest
        words = [w.lower() for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", u))]
        content = [w for w in words if w not in ("the", "a", "an", "this", "method", "function")]
        if own and content and [w for w in content] == own or own and "".join(content) == "".join(own) or own and content and set(content) <= set(own):
            continue
        if own and len(content) <= len(own) + 1 and all(any(w == o or w in (o + "s", o + "es", o + "ing", o + "ed") for o in own) for w in content):
            continue
        if len(words) < 2 and not re.search(r"[\u0e00-\u0eff\u0900-\u097f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af].{3,}", u):
            continue
        kept.append(u)
    return " ".join(kept)


def pairs(chunks: DataFrame) -> DataFrame:
    """Functions and methods with a description: ``chunk_id, symbol_name, code, description``.

    ``code`` is the function from its signature to the end of its body, without what the
    excerpt holds around it.
    Chunks of other kinds, with a null id, or without any description give no row; a chunk
    delivered twice gives one. Null excerpts, names and docs are allowed. Extra columns are
    ignored; an empty table gives an empty result; excerpts are read whole.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            said = [tells(attached(d, e), n) for d, e, n in zip(f["doc"], f["excerpt"], f["symbol_name"])]
            out = pd.DataFrame({"chunk_id": f["chunk_id"], "symbol_name": f["symbol_name"], "code": f["excerpt"], "description": said})
            out = out[out["description"] != ""]
            out["code"] = [code_of(e) for e in out["code"]]
            if len(out):
                yield out

    source = chunks.filter(F.col("chunk_id").isNotNull() & F.lower(F.trim("kind")).isin("function", "method")).select("chunk_id", "symbol_name", "excerpt", "doc")
    return source.mapInPandas(run, "chunk_id long, symbol_name string, code string, description string").dropDuplicates(["chunk_id"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose documentation tells something."""
    return pairs(table(spark, folder, "semantic_chunks")).select("chunk_id")


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs themselves."""
    return pairs(table(spark, folder, "semantic_chunks"))


QUERIES = {"p6_found": p6_found, "p6_pairs": p6_pairs}
SQL: dict[str, str] = {}
