"""Problem 5: source files that do not parse.

1. Every file's lines are brought together once and lexed; the result is a row a file:
   its tokens (classes, with the line ends that count), the brackets, block keywords and
   indentations that its lines leave over, and its distinct statement shapes (the tokens of
   a statement or of a bracket, with the contents of brackets folded).
2. Adjacent tokens are paired in their row, and the distinct pairs are anti-joined with the
   pairs that the language's grammar permits.
3. Nesting is validated by windows: the running sum gives each bracket its level, and
   within a level every closing bracket must follow an opening one of its kind.
4. Statement shapes are matched against the productions of the language.

A file with any violation is invalid. For Python and JSON, whose parsers are at hand, the
files so found are confirmed by an exact parse.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark.llm.grammar import GRAMMARS, pairs
from siftspark.session import checkpoint
from siftspark.sources.tables import table

EXTENSIONS = {
    "py": "python", "pyi": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript",
    "go": "go", "rs": "rust", "java": "java", "cs": "csharp", "rb": "ruby", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "php": "php", "json": "json",
}
_CLASSES = set("i n s v c B S U I A NL CNL EOF BOF lab sym op text open life ann ifx".split())
_SOFT = {
    "javascript": "of get set static async from type as await", "typescript": "satisfies of get set static async from type as await declare abstract readonly namespace module is keyof infer unique asserts override public private protected enum interface implements",
    "python": "match case type _", "java": "record sealed permits yield var when", "csharp": "from orderby select join on equals into let group by ascending descending not and or checked unchecked fixed get set init add remove where when with value var dynamic required record partial async await nameof yield in event params",
    "kotlin": "where open data sealed inline companion enum operator infix inner annotation vararg tailrec external actual expect to until downTo step get set constructor init by out reified override abstract final lateinit const internal public private protected suspend",
    "swift": "get set willSet didSet open some any mutating lazy weak unowned convenience required indirect nonmutating async await actor override final", "rust": "union async await", "ruby": "private public protected module_function", "php": "insteadof goto enum readonly match fn list final abstract static", "c": "override final mutable explicit friend virtual constexpr typename template using namespace operator new delete try catch throw class public private protected this true false nullptr bool auto", "cpp": "override final", "go": "",
}
_LINES = {"python", "javascript", "typescript", "go", "kotlin", "swift", "ruby"}
_CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7}|={7})(?:[ \t].*)?$", re.MULTILINE)
_BLOCK = {"rust", "swift", "kotlin"}  # nested block comments
_NUMBER = r"(?:0[xX][0-9a-fA-F_']*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bBoO][0-9_']+|\d[\d_]*(?:'\d[\d_]*)*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*)"
_OPS = "&^= &^ >>>= <=> === !== **= <<= >>= ... ..< ..= ??= &&= ||= ?-> -> => :: ++ -- += -= *= /= %= &= |= ^= .= == != <= >= && || << >> ?? ?. ?: !! := <- &. .. ** =~ !~ ~= // @ # + - * / % & | ^ ~ ! < > = ? : ; , . ( ) [ ] { } \\ $".split()
# Marks of several characters that only some languages have; elsewhere they are read as their parts.
_ONLY = {
    "&^=": "go", "&^": "go", ">>": "python javascript go c ruby php", ">>>": "javascript",  # elsewhere two marks that may close type arguments
    "?:": "kotlin", "!!": "kotlin", "<-": "go", "//": "python", "&.": "ruby", "?->": "php", "=~": "ruby", "!~": "ruby", "~=": "swift", "<=>": "ruby php cpp", "**": "python javascript typescript ruby php", "**=": "python javascript typescript ruby php",
    "..<": "swift", "..=": "rust", "&&=": "javascript typescript ruby", "||=": "javascript typescript ruby", "??=": "javascript typescript csharp php", "??": "javascript typescript csharp php swift", "===": "javascript typescript php ruby kotlin swift", "!==": "javascript typescript php kotlin swift",
    ":=": "go python", "::": "c cpp rust java php ruby kotlin csharp", "?.": "javascript typescript kotlin swift csharp", "=>": "javascript typescript rust csharp php ruby", "->": "c cpp rust java php ruby kotlin swift python csharp", "..": "rust ruby kotlin csharp", 
    "++": "javascript typescript go java csharp c cpp php kotlin", "--": "javascript typescript go java csharp c cpp php kotlin",
}


@cache
def _op(lang: str) -> str:
    own = [o for o in _OPS if lang in _ONLY.get(o, lang).split()]
    return "|".join(re.escape(o) for o in sorted(own, key=len, reverse=True))


@cache
def _after(lang: str) -> re.Pattern:
    return re.compile(r"[ \t]*(\n|" + _op(lang) + r"|[\"'`]|\w)?")


_PAIRED = {")": "(", "]": "[", "}": "{"}


@cache
def keywords(lang: str) -> frozenset[str]:
    words = {t for pair in pairs(lang) for t in pair if re.fullmatch(r"[A-Za-z_]+", t)} - _CLASSES
    return frozenset(words)


@cache
def _op_class(lang: str) -> dict[str, str]:
    own = {t for pair in pairs(lang) for t in pair}
    out = {}
    for o in _OPS:
        if o in ("+", "-"):
            out[o] = "S"
        elif o in ("++", "--"):
            out[o] = "I"
        elif o in ("=", ":=") and not (o == ":=" and lang == "python") or o.endswith("=") and o not in ("==", "!=", "<=", ">=", "===", "!==", "..=", ":=", "~="):
            out[o] = "A"
        elif o == "..=":
            out[o] = ".."
        elif o == "//" and lang == "python":
            out[o] = "B"
        elif o in own:
            out[o] = o
        elif o == "~":
            out[o] = "U"
        elif o in ("==", "!=", "<=", ">=", "&&", "||", "|", "^", "%", "/", "<<", ">>", "===", "!==", "**", "<=>", "=~", "!~", "~=", "&", "<", ">", "*"):
            out[o] = "B"
        elif o == "!":
            out[o] = "U"
        else:
            out[o] = "bad:" + o
    return out


@cache
def _scanner(lang: str) -> re.Pattern:
    dq, sq = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
    comment = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
    if lang == "python":
        parts = [r"(?P<c>#[^\n]*)", r"(?P<cont>\\\n)", r"(?P<s>[rRbBfFuUtT]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|" + dq + "|" + sq + "))"]
    elif lang == "ruby":
        parts = [r"(?P<c>#[^\n]*|^=begin\b[\s\S]*?^=end[^\n]*)", r"(?P<cont>\\\n)", r"(?P<heredoc><<[~-]?([\"']?)(?P<tag>[A-Z_]+)\2[^\n]*\n[\s\S]*?^\s*(?P=tag)\b)", "(?P<s>" + dq.replace(r"\n", "") + "|" + sq.replace(r"\n", "") + r"|`[^`]*`|%[wWiIqQr]?(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\}))", r"(?P<sym>:(?:[A-Za-z_]\w*[?!=]?|\"[^\"\n]*\")(?<!::))", r"(?P<lab>[A-Za-z_]\w*[?!]?:(?!:))", r"(?P<v>@@?[A-Za-z_]\w*|\$[A-Za-z_0-9!@&~]\w*)", r"(?P<w>[A-Za-z_]\w*[?!]?(?![=~]=)|[A-Za-z_]\w*)"]
    elif lang == "php":
        parts = [r"(?P<open><\?(?:php\b|=))", r"(?P<end>\?>)", "(?P<c>" + comment + r"|#(?!\[)[^\n]*)", r"(?P<s><<<(?P<hq>['\"]?)(?P<tag>[A-Za-z_]+)(?P=hq)\n[\s\S]*?^\s*(?P=tag)\b|" + dq.replace(r"\n", "") + "|" + sq.replace(r"\n", "") + ")", r"(?P<v>\$+[A-Za-z_]\w*)"]
    elif lang == "json":
        parts = [r"(?P<s>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")", r"(?P<n>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))"]
    elif lang in ("javascript", "typescript"):
        parts = ["(?P<c>" + comment + ")", r"(?P<s>`(?:[^`\\]|\\[\s\S])*`|" + dq + "|" + sq + ")"]
    elif lang == "go":
        parts = ["(?P<c>" + comment + ")", "(?P<s>`[^`]*`|" + dq + "|" + sq + ")"]
    elif lang == "rust":
        parts = ["(?P<c>" + comment + ")", r"(?P<s>[bc]?r(?P<h>#*)\"[\s\S]*?\"(?P=h)|[bc]?" + dq.replace(r"\n", "") + r"|b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F]+\}|x[0-9a-fA-F]{2}|.))')", r"(?P<life>'[A-Za-z_]\w*(?!'))"]
    elif lang == "csharp":
        parts = ["(?P<c>" + comment + r"|^[ \t]*#[^\n]*)", r"(?P<s>\"\"\"[\s\S]*?\"\"\"|[$]?@[$]?\"(?:[^\"]|\"\")*\"|[$]?" + dq + "|" + sq + ")"]
    elif lang in ("kotlin", "swift"):
        parts = ["(?P<c>" + comment + ")", r"(?P<s>(?P<h>#+)\"[\s\S]*?\"(?P=h)|\"\"\"[\s\S]*?\"\"\"|" + dq + ("|" + sq if lang == "kotlin" else "") + ")"]
        parts += [r"(?P<c2>(?<=\w)@\w+|@(?=\s)|(?<=return)@\w+)"] if lang == "kotlin" else [r"(?P<dollar>\$\w+)"]
    else:
        parts = ["(?P<c>" + comment + (r"|^[ \t]*#(?:[^\\\n]|\\[\s\S])*" if lang in ("c", "cpp") else "") + ")", r"(?P<s>(?:u8|[uUL])?(?:R\"(?P<d>[^()\\ ]*)\([\s\S]*?\)(?P=d)\"|\"\"\"[\s\S]*?\"\"\"|" + dq + "|" + sq + "))"]
    if lang not in ("json",):
        parts.append(r"(?P<n>" + _NUMBER + r"(?:[uUlLfFdDmMnij]{0,3}" + ("|_[A-Za-z]\\w*" if lang == "cpp" else "") + r"|[iu](?:8|16|32|64|128|size)|f(?:32|64)|r)(?![\w]))")
    if lang != "ruby":
        parts.append(r"(?P<w>[A-Za-z_$][\w$]*)" if lang in ("javascript", "typescript", "java") else r"(?P<w>`[A-Za-z_]\w*`|[^\W\d]\w*)")
    parts.append("(?P<o>" + _op(lang) + ")")
    parts.append(r"(?P<nl>\n)|(?P<x>\S)")
    return re.compile("|".join(parts), re.MULTILINE)


def _regex_ok(prev: str) -> bool:
    return prev in ("BOF", "NL", "CNL", "(", ",", "A", "B", "S", "[", "{", "}", ";", ":", "?", "!", "=>", "return", "U", "&", "*", "<", ">", "of", "in", "if", "unless", "when", "and", "or", "not", "while", "typeof", "case", "lab", "~")


_WORD = re.compile(r"\w+")
_TAG = re.compile(r"<([A-Za-z_$][\w$.:-]*)?")
_ATTRIBUTE = re.compile(r"\s*[\w:.$-]+\s*=?\s*")
_SPACE = re.compile(r"\s*")
_DIRECTIVE = re.compile(r"[ \t]*#(?:[^\\\n]|\\[\s\S])*")
_MACRO = re.compile(r"(?:macro_rules\s*!\s*\w+|\w+\s*!)\s*(?=[(\[{])")
# Strings with code in them: opening mark of the string, of the code, and its end.
_INTERPOLATED = {
    "javascript": [("`", "`", "${", "}")], "typescript": [("`", "`", "${", "}")], "csharp": [('$"', '"', "{", "}"), ('$@"', '"', "{", "}"), ('@$"', '"', "{", "}")], "ruby": [('"', '"', "#{", "}"), ("`", "`", "#{", "}")],
    "kotlin": [('"""', '"""', "${", "}"), ('"', '"', "${", "}")], "swift": [('"""', '"""', "\\(", ")"), ('"', '"', "\\(", ")")],
}


def _balanced(text: str, at: int, close: str) -> int:
    """Behind the ``close`` that ends the code which begins at ``at``; -1 if there is none."""
    open_, depth, n = {"}": "{", ")": "(", "]": "["}[close], 0, len(text)
    while at < n:
        c = text[at]
        if c in "\"'`":
            stop = at + 1
            while stop < n and text[stop] != c and (text[stop] != "\n" or c == "`"):
                stop += 2 if text[stop] == "\\" else 1
            if stop < n and text[stop] == c:
                at = stop
        elif c == open_:
            depth += 1
        elif c == close:
            if not depth:
                return at + 1
            depth -= 1
        at += 1
    return -1


def _interpolated(text: str, at: int, lang: str) -> int:
    """Behind the string with code in it that begins at ``at``; -1 if none does."""
    for begin, end, code, close in _INTERPOLATED.get(lang, ()):
        if not text.startswith(begin, at):
            continue
        i, n, lines = at + len(begin), len(text), len(end) == 3 or end == "`" or "@" in begin or lang == "ruby"
        while i < n:
            if text.startswith(end, i):
                return i + len(end)
            if text.startswith(code, i) and not (lang == "csharp" and text.startswith("{{", i)):
                i = _balanced(text, i + len(code), close)
                if i < 0:
                    return -1
            elif text[i] == "\\" and "@" not in begin or text.startswith("{{", i):
                i += 2
            elif text[i] == "\n" and not lines:
                return -1
            else:
                i += 1
        return -1
    return -1


def _jsx(text: str, at: int) -> int:
    """Behind the markup element that begins at ``at``; -1 if none does."""
    m = _TAG.match(text, at)
    name, i, n = m.group(1) or "", m.end(), len(text)
    if text.startswith("<", i) and name:
        i = text.find(">", i) + 1
    while True:
        i = _SPACE.match(text, i).end()
        if text.startswith("/>", i):
            return i + 2
        if i >= n:
            return -1
        if text[i] == ">":
            i += 1
            break
        if text[i] == "{":
            i = _balanced(text, i + 1, "}")
        elif text[i] in "\"'":
            i = text.find(text[i], i + 1) + 1
        elif name and (a := _ATTRIBUTE.match(text, i)) and a.end() > i:
            i = a.end()
        else:
            return -1
        if i <= 0:
            return -1
    while i < n:
        if text[i] == "{":
            i = _balanced(text, i + 1, "}")
        elif text.startswith("</", i):
            m = re.compile(r"</\s*" + re.escape(name) + r"\s*>").match(text, i)
            return m.end() if m else -1
        elif text[i] == "<":
            i = _jsx(text, i)
        else:
            i += 1
        if i < 0:
            return -1
    return -1


_RX = re.compile(r"/(?![*/\s])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


def lex(text: str, lang: str) -> list[tuple[str, int]]:
    """``(class, line)`` of the tokens; ``bad:...`` for what the language does not have."""
    out: list[tuple[str, int]] = []
    scan, kws, ops, permitted = _scanner(lang), keywords(lang), _op_class(lang), pairs(lang)
    soft = frozenset(_SOFT.get(lang, "").split())
    by_line, py = lang in _LINES, lang == "python"
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    if text.startswith("#!") and lang != "json":
        text = "//" + text[2:] if lang not in ("python", "ruby", "php") else ("#" + text[2:] if lang != "php" else text[text.find("\n") + 1 :])
    pos, line, n, depth, prev = 0, 1, len(text), [], "BOF"
    indents, fresh = [0], True
    conflicts = lang != "json" and _CONFLICT.search(text) is not None
    directives = lang in ("c", "cpp", "csharp", "swift") and "#" in text
    blanks, name = re.compile(r"[ \t]+").match, re.compile(r"[A-Za-z_$][\w$]*" if lang in ("javascript", "typescript", "java") else r"[^\W\d]\w*").match
    simple, marks, plain, quotes = frozenset("()[]{};,") & frozenset(ops), frozenset(x[0][0] for x in _INTERPOLATED.get(lang, ())), lang not in ("ruby", "kotlin", "json"), frozenset("\"'#")
    if lang == "php":
        first = re.search(r"<\?(?:php\b|=)", text)
        if not first:
            return [("bad:no code", 1)] if text.strip() else []
        if text[: first.start()].strip():
            out.append(("text", 1))
        pos = first.start()
    while pos < n:
        if fresh:
            if conflicts and (m := _CONFLICT.match(text, pos)):
                out.append(("bad:conflict", line))
                pos, fresh = m.end(), False
                continue
            if py and not depth:
                m = re.compile(r"[ \t\f]*").match(text, pos)
                rest = text[m.end() : m.end() + 1]
                if rest and rest not in "\n#":
                    width = len(m.group().expandtabs(8))
                    if width > indents[-1]:
                        indents.append(width)
                        out.append((">>", line))
                        prev = ">>"
                    while width < indents[-1]:
                        indents.pop()
                        out.append(("<<", line))
                        prev = "<<"
                        if width > indents[-1]:
                            out.append(("bad:dedent", line))
                            indents.append(width)
            fresh = False
            if directives and (m := _DIRECTIVE.match(text, pos)) and not (lang == "swift" and not re.match(r"[ \t]*#(?:if|elseif|else|endif|warning|error|sourceLocation)\b", m.group())):
                line += m.group().count("\n")
                pos = m.end()
                continue
        c = text[pos]
        if c == " " or c == "\t":
            pos = blanks(text, pos).end()
            continue
        if c in "\f\v\u00a0":
            if c == "\u00a0" and py:
                out.append(("bad:blank", line))
            pos += 1
            continue
        if c in simple:  # marks that begin no longer one
            cls = ops[c]
            if c in "([{":
                depth.append(c)
            elif c in ")]}" and depth:
                depth.pop()
            out.append((cls, line))
            pos, prev = pos + 1, cls
            continue
        if c == "/" and lang in ("javascript", "typescript", "ruby") and _regex_ok(prev) and (m := _RX.match(text, pos)):
            kind, word = "s", m.group()
        elif c in marks and (stop := _interpolated(text, pos, lang)) > 0 or c == "<" and lang in ("javascript", "typescript") and _regex_ok(prev) and text[pos + 1 : pos + 2].strip("=-<0123456789 (") and (stop := _jsx(text, pos)) > 0:
            out.append(("s", line))
            line, pos, prev = line + text.count("\n", pos, stop), stop, "s"
            continue
        elif lang == "rust" and (c.isalpha() or c == "_") and prev not in ("#",) and (m := _MACRO.match(text, pos)) and (stop := _balanced(text, m.end() + 1, {"(": ")", "[": "]", "{": "}"}[text[m.end()]])) > 0:
            mark = text[m.end()]  # what a macro takes is its own affair, but its brackets must close
            group = [("i", line), ("!", line), *([("i", line)] if m.group().startswith("macro_rules") else []), (mark, line), ({"(": ")", "[": "]", "{": "}"}[mark], line)]
            out += group
            line, pos, prev = line + text.count("\n", pos, stop), stop, group[-1][0]
            continue
        elif plain and (c.isalpha() or c == "_") and (m := name(text, pos)) and text[m.end() : m.end() + 1] not in quotes:
            kind, word = "w", m.group()
        else:
            m = scan.match(text, pos)
            if not m:
                out.append(("bad:" + c, line))
                pos += 1
                continue
            kind, word = m.lastgroup, m.group()
            if kind in ("tag", "h", "d", "hq"):
                kind = "s"
        pos = m.end()
        at = line
        if kind != "w" and kind != "o":
            line += word.count("\n")
        if kind == "c":
            if lang in _BLOCK and word.startswith("/*"):
                level = word.count("/*", 2)
                while level > 0 and pos < n:
                    stop = text.find("*/", pos)
                    if stop < 0:
                        out.append(("bad:comment", at))
                        pos = n
                        break
                    level += text.count("/*", pos, stop) - 1
                    line += text.count("\n", pos, stop)
                    pos = stop + 2
            if "\n" in word and lang not in ("python",):
                pass
            continue
        if kind == "nl":
            fresh = True
            inside = depth and depth[-1] in "(["
            if by_line and not inside and not (py and depth) and prev not in ("BOF", "NL", "CNL", "<<", ">>"):
                prev = "CNL" if py and prev == ":" else "NL"
                out.append((prev, at))
            continue
        if kind in ("cont", "c2"):  # a label of Kotlin
            continue
        if kind == "dollar":
            kind, word = "w", "_0"
        if kind in ("s", "heredoc"):
            cls = "s"
        elif kind == "end":
            cls = "?>"
            nxt = re.compile(r"<\?(?:php\b|=)").search(text, pos)
            pos = nxt.start() if nxt else n
        elif kind in ("n", "life", "v", "sym", "lab", "open"):
            cls = kind
            if kind == "lab" and prev in ("?",):
                cls, pos = "i", pos - 1
            if kind == "lab" and word[:-1] in kws and prev not in ("(", ",", "{"):
                pos -= 1
                cls = word[:-1]
        elif kind == "w":
            cls = word if word in kws else "c" if lang == "ruby" and word[0].isupper() else "i"
            if (prev in (".", "?.", "&.", "?->") or prev == "->" and lang in ("c", "cpp", "php")) and not (lang == "rust" and word == "await") and not (lang in ("swift", "java") and word in ("self", "init", "new", "class", "this", "super")) and not (lang == "python" and word == "import"):
                cls = "i"
            elif word in soft and cls != "i":
                after = _after(lang).match(text, pos)
                a = after.group(1) or "\n"
                nxt = _WORD.match(text, after.start(1)).group() if after.group(1) and a.isalnum() else ""
                b = ops.get(a, "NL" if a == "\n" else "s" if a in "\"'`" else "n" if a.isdigit() else "i")
                b = nxt if nxt in kws else b
                if (prev, "i") in permitted and ("i", b) in permitted and not ((prev, word) in permitted and (word, b) in permitted and (b in ("i", "s", "{", "[", "n", "(") or nxt in kws)):
                    cls = "i"
                elif (prev, word) not in permitted:
                    cls = "i"
        elif kind == "o":
            cls = ops[word]
            if word in "([{":
                depth.append(word)
            elif word in ")]}" and depth:
                depth.pop()
            elif word == ":" and lang == "ruby" and prev == "?":
                cls = ":"
        else:
            cls = "bad:" + ("quote" if word in "\"'`" else word if ord(word) < 128 else "char")
        out.append((cls, at))
        prev = cls
    if py:
        if prev not in ("BOF", "NL", "CNL", "<<", ">>"):
            out.append(("CNL" if prev == ":" else "NL", line))
        out += [("<<", line)] * (len(indents) - 1)
    return out


_RUBY_OPEN = {"def", "class", "module", "begin", "do", "case"}
_RUBY_COND = {"if", "unless", "while", "until", "for"}
# Languages whose line ends count unless the next line begins with one of these.
_CARRIED = {"go": frozenset(), "ruby": frozenset([".", "&."]), "kotlin": frozenset([".", "?.", "?:", "else", "as", "B", "{", "catch", "finally"]), "swift": frozenset([".", "?.", "B", "??", "?", ":", "else", "catch"])}
_BODY = {"else", "do", "try", "finally", "=>", "->", "unsafe", "static", "default", "const", "override", "noexcept"}
_OWNERS = {"class", "struct", "interface", "record", "namespace", "union", "trait", "impl", "mod", "protocol", "extension", "object"}
_AT_START = {"BOF", "NL", ";", "then", "do", "else", "begin", "A", "(", "{", "[", ",", "ensure", "return", "B", "&&", "||", "and", "or", "not", "=>", "elsif", "|"}


def _endless(tokens: list[tuple[str, int]], k: int) -> bool:
    """Is the Ruby method at ``k`` defined by one expression, without an end?"""
    k += 2
    if k + 1 < len(tokens) and tokens[k][0] == ".":
        k += 2
    if k < len(tokens) and tokens[k][0] == "(":
        depth = 0
        while k < len(tokens):
            depth += (tokens[k][0] == "(") - (tokens[k][0] == ")")
            k += 1
            if not depth:
                return k < len(tokens) and tokens[k][0] == "A"
        return False
    return k + 1 < len(tokens) and tokens[k][0] == "A" and tokens[k + 1][0] != "("


def facts(tokens: list[tuple[str, int]], lang: str) -> tuple[list[str], list[tuple[str, str]], set[str]]:
    """The tokens with the line ends that count, left-over brackets in order, and distinct statement shapes."""
    permitted = pairs(lang)
    stream = ["BOF"]
    marks: list[tuple[str, str]] = []  # (open or close, kind)
    lines: list[int] = []
    shapes: set[str] = set()
    prev, brk = "BOF", False
    strict, carried = lang in _CARRIED, _CARRIED.get(lang, frozenset())
    by_line, py = lang in _LINES, lang == "python"
    loops = 0  # Ruby loops whose "do" is still to come
    base: list[tuple[str, list[str]]] = [("top", [])]

    def mark(kind: str, sign: str, at: int) -> None:
        if sign == "close" and marks and marks[-1] == ("open", kind) and lines[-1] == at:
            marks.pop()
            lines.pop()
        else:
            marks.append((sign, kind))
            lines.append(at)

    def finish(level: list[str]) -> None:
        if level:
            shapes.add(" ".join(level))
            level.clear()

    for k, (t, at) in enumerate(tokens):
        if t == "NL" and by_line and not py:
            brk = True
            nxt = tokens[k + 1][0] if k + 1 < len(tokens) else "EOF"
            level = base[-1][1]
            over = (prev, "NL") in permitted and nxt not in carried if strict else (prev, nxt) not in permitted
            if level and over and base[-1][0] not in ("(", "["):
                finish(level)
            if lang == "ruby":
                loops = 0
            continue
        if brk:
            brk = False
            if strict and t not in carried and (prev, "NL") in permitted or (prev, t) not in permitted:
                stream.append("NL")
            start = True
        else:
            start = prev in _AT_START
        stream.append(t)
        level = base[-1][1]
        if t in "([{" and len(t) == 1:
            mark(t, "open", at)
            block = t == "{" and (prev == ")" and "A" not in level and level[:1] != ["return"] or prev in _BODY and not (lang == "php" and prev == "->") or bool(_OWNERS & set(level)) and "A" not in level and "enum" not in level)
            level.append(t)
            base.append((t if not block else "block", []))
        elif t in _PAIRED:
            mark(_PAIRED[t], "close", at)
            inner = []
            if len(base) > 1:
                kind, inner = base.pop()
                empty = not inner
                if inner and (kind in "([" or lang == "json"):  # what brackets hold is a production too
                    shapes.add(f"{t} " + " ".join(inner))
                if kind == "block" and not by_line and inner:
                    shapes.add(" ".join(inner) + " ~")
                elif kind == "block":
                    finish(inner)
                level = base[-1][1]
                level.append(t if empty else t)
            nxt = tokens[k + 1][0] if k + 1 < len(tokens) else "EOF"
            if t == "}" and base[-1][0] in ("top", "{", "block") and not py and lang not in ("json", "ruby"):
                if not (set(level[:1]) & {"return", "import", "throw", "new"} or "A" in level or "=>" in level or "new" in level or "default" in level) and nxt not in ("else", "catch", "finally", "while", "elseif", ".", ")", ",", "(", "as", "from", "?.", "elif", "when", ";"):
                    finish(level)
                elif nxt == "while" and level[:1] != ["do"] and level[:1] != ["repeat"]:
                    finish(level)
        elif t == ";" and base[-1][0] in ("top", "{", "block"):
            level.append(";")
            if not (lang == "go" and level[0] in ("if", "for", "switch")):
                finish(level)
        elif py and t in ("NL", "CNL"):
            level.append(t)
            finish(level)
        elif py and t in (">>", "<<"):
            mark(">>", "open" if t == ">>" else "close", k)
            base[:] = base[:1]
        else:
            level.append(t)
            if lang == "ruby":
                if t in _RUBY_COND and (start or prev in _AT_START):
                    mark("end", "open", at)
                    loops += t in ("while", "until", "for")
                elif t == "do" and loops:
                    loops -= 1
                elif t == "def" and _endless(tokens, k):
                    pass
                elif t in _RUBY_OPEN and prev not in (".", "::", "def") and not (t == "class" and prev == "B"):
                    mark("end", "open", at)
                elif t == "end" and prev not in (".", "def"):
                    mark("end", "close", at)
        prev = t
    stream.append("EOF" if not (by_line and not py) or (prev, "EOF") in permitted else "NL")
    tail = base[0][1]
    if tail:
        shapes.add(" ".join(tail) + ("" if by_line or lang == "json" else " ~"))
    return stream, marks, shapes


_P = r"\( \)"
_NEED = r"^(?:if|while|switch|catch|foreach)\b(?! (?:constexpr )?\()"
# Productions that a statement shape must not break: (languages, expression of a violation).
VIOLATIONS = [
    ("java csharp go javascript typescript php rust", r"(?:^| )i i i(?: |$)"),
    ("c cpp", r"(?:^| )i i i(?! \()(?: |$)"),
    ("kotlin", r"(?:^|[;}] )i i(?: ;|$)|(?:^| )i i i i(?: |$)"),
    ("ruby", r"(?:^| )i i i(?: |$)"),
    ("javascript php rust", r"(?:^| )i i(?: |$)"),
    ("typescript", r"(?:^|[^@] )i i(?: |$)"),
    ("swift", r"(?:^|[^@] )i i(?! :)(?: |$)"),
    ("java c cpp csharp", r"^\) (?:.* )?,$|^(?:int|long|double|float|char|short|void|boolean|bool|byte) A"),
    ("javascript java php csharp", r"(?:^|[^:] )new ;"),
    ("javascript typescript java c cpp csharp php", r"^do \{ \}(?! while)(?: ~)?$"),
    ("java php csharp", r"^class \{"),
    ("kotlin php", r"^try \{ \}$"),
    ("c", r" A ;$"), ("cpp", r"(?<!operator) A ;$"),
    ("kotlin swift go javascript typescript", r" A$"),
    ("swift", r"^(?:if|while|switch|for) \{|^(?:let|var) (?:let|var)\b|^catch \{|^guard\b(?!.* else \{)"),
    ("rust", r"^let i n\b|^(?:pub )?fn \(|^match \{|^i => "),
    ("go", r"^if \{|^return return"),
    ("php", r"^\) (?:.* )?, ,"),
    ("json", r"^\} (?!s : (?:s|n|true|false|null|\[ \]|\{ \})(?: , s : (?:s|n|true|false|null|\[ \]|\{ \}))*$)|^\] (?!(?:s|n|true|false|null|\[ \]|\{ \})(?: , (?:s|n|true|false|null|\[ \]|\{ \}))*$)"),
    ("javascript typescript java csharp c cpp php", _NEED),
    ("javascript typescript java csharp c cpp php", r"^for\b(?! (?:await )?\()"),
    ("javascript typescript java csharp php cpp", r"^try \{ \}$|^try(?! [{(])"),
    ("java csharp c cpp php", r"[^;}:{>] ~$"),
    ("rust", r"^(?:let|use|const|static|type|mod)\b(?!.*[;}])"),
    ("rust", r"^(?:pub )?fn i(?!.*(?:\{ \}|;))|^impl\b(?!.*\{ \})"),
    ("javascript typescript", r"^(?:export (?:default )?)?(?:async )?function (?!(?:\* )?(?:i )?(?:<[^(]*> )?\()|^(?:export )?class i(?!.*\{ \})|^(?:export )?const (?:i|: )+;$|^import (?!.*s)(?!\()"),
    ("javascript", r"^(?:export )?(?:async )?function i \( \)(?! \{)"),
    ("javascript", r"^(?:export )?(?:let|const|var) (?:i|\[ \]|\{ \}) :|^(?:export )?(?:async )?(?:function )?i \( \) :"),
    ("go", r"^func\b(?!.*\{ \})|^(?:if|for|switch|select)\b(?!.*\{ \})|^import(?! [i.]? ?s)(?! \( \))"),
    ("kotlin", r"^(?:if|while|for)(?! \()|^class i(?=.* NL)"),
    ("swift", r"^(?:if|guard|while|for|switch)\b(?!.*\{ \})"),
    ("java", r"^(?:(?:public|private|protected|static|final|abstract) )*class i(?!.*\{ \})"),
    ("php", r"^(?:(?:public|private|protected|static|final|abstract) )*function i \( \)(?! \{)(?! :)(?! ;)|^class i(?!.*\{ \})"),
    ("python", r"^(?:async )?(?:def|class|if|elif|else|for|while|try|except|finally|with)\b(?!.* :(?: |$))|^(?:async )?def (?!i|soft|match|type|case|_)|^class (?!i|match|type|case|_)|^(?:if|elif|while) :|^(?:try|else|finally) (?!:)"),
    ("ruby", r"^(?:def|class|module)(?: NL)?$"),
]
# What may stand outside of all blocks, where a language restricts it.
TOPS = {
    "java": r"^(?:package|import|;|@|(?:(?:public|private|protected|static|final|abstract|sealed|strictfp|default) )*(?:class|interface|enum|record)\b)",
    "go": r"^(?:package|import|func|var|const|type|;)\b",
    "rust": r"^(?:#|pub|use|mod|fn|struct|enum|impl|trait|const|static|type|extern|unsafe|async|i !)",
    "csharp": r"^(?!return|if|for|case|break)",
    "c": r"^(?!return|if|for|while|switch|case|break|continue|else|do|goto)(?!i \( \) ;$)(?!i A)",
    "cpp": r"^(?!return|if|for|while|switch|case|break|continue|else|do|goto)(?!i \( \) ;$)(?!i A)",
}


def _tops(tokens: list[tuple[str, int]], lang: str) -> set[str]:
    """Heads of the statements outside of all blocks, for the languages of ``TOPS``."""
    if lang not in TOPS:
        return set()
    out, depth, cur = set(), 0, []
    for t, _ in tokens:
        if t == "NL":
            if lang == "go" and not depth and cur:
                out.add(" ".join(cur))
                cur = []
            continue
        if t in "([{" and len(t) == 1:
            if not depth:
                cur.append(t)
            depth += 1
        elif t in _PAIRED:
            depth = max(0, depth - 1)
            if not depth:
                cur.append(t)
                if t == "}" and "A" not in cur and "import" not in cur and "use" not in cur:
                    out.add(" ".join(cur))
                    cur = []
        elif not depth:
            cur.append(t)
            if t == ";":
                out.add(" ".join(cur))
                cur = []
    if cur:
        out.add(" ".join(cur))
    return out


@cache
def _violations(lang: str) -> re.Pattern:
    rules = [rule for langs, rule in VIOLATIONS if lang in langs.split()]
    return re.compile("|".join(f"(?:{r})" for r in rules) or r"(?!)")


_PY_NEXT = {"except": {"try", "except"}, "elif": {"if", "elif"}, "else": {"if", "elif", "for", "while", "except"}, "finally": {"try", "except", "else"}}


def _siblings(tokens: list[tuple[str, int]]) -> set[tuple[str, str]]:
    """Pairs of neighbouring Python statement heads that depend on each other."""
    out, stack, head = set(), [["BOF"]], True
    for t, _ in tokens:
        if t == ">>":
            stack.append(["BOF"])
            head = True
        elif t == "<<":
            if stack[-1][0] == "try":
                out.add(("#try", "#end"))
            if len(stack) > 1:
                stack.pop()
            head = True
        elif t in ("NL", "CNL"):
            head = True
        elif head:
            if t == "async":
                continue
            head = False
            if stack[-1][0] == "try" or t in _PY_NEXT:
                out.add(("#" + stack[-1][0], "#" + t if t in _PY_NEXT else "#stmt"))
            stack[-1][0] = t if t in ("try", "except", "if", "elif", "else", "for", "while", "finally") else "stmt"
    if stack[-1][0] == "try":
        out.add(("#try", "#end"))
    return out


def permissible(spark: SparkSession) -> DataFrame:
    """The table ``language, pair`` of the grammars (two classes with a blank between); its size does not depend on the data."""
    rows = [(lang, f"{a} {b}") for lang in GRAMMARS for a, b in pairs(lang)]
    rows += [("python", f"#{a} #{b}") for b, many in _PY_NEXT.items() for a in many]
    return spark.createDataFrame(rows, "language string, pair string")


def texts(files: DataFrame, lines: DataFrame) -> DataFrame:
    """``file_id, repo, path, language, text`` of the files in scope; the lines joined by line feeds."""
    ext = F.lower(F.regexp_extract(F.regexp_replace("path", r"\\", "/"), r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    once = files.filter("file_id IS NOT NULL AND path IS NOT NULL").groupBy("file_id").agg(F.max(F.struct("indexed_at", "path", "repo")).alias("f")).select("file_id", "f.path", "f.repo")
    scope = once.withColumn("language", F.element_at(known, ext)).filter("language IS NOT NULL")
    line = F.struct("line_no", F.coalesce("content", F.lit("")).alias("content"))
    joined = lines.filter("file_id IS NOT NULL AND line_no IS NOT NULL").groupBy("file_id").agg(F.array_sort(F.collect_set(line)).alias("l"))
    return scope.join(joined, "file_id", "left").withColumn("text", F.coalesce(F.array_join(F.col("l.content"), "\n"), F.lit(""))).drop("l")


def invalid(files: DataFrame, lines: DataFrame, exact: bool = True) -> DataFrame:
    """``file_id, repo, language, valid`` of every file of a known language.

    ``exact`` lets the exact parsers of Python and JSON confirm what was found there.
    The language is that of the path's extension, in any letter case. A file delivered twice
    counts once (its latest delivery), a line delivered twice once; null contents are empty
    lines; null ids or paths give no row; a file without lines is an empty text (valid but
    for JSON). Extra columns are ignored; empty tables give an empty result. A file is one
    unit of work, as its syntax is; files are spread by a hash of their id.
    """
    spark = files.sparkSession
    source = checkpoint(texts(files, lines))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for file_id, lang, text in zip(f["file_id"], f["language"], f["text"]):
                tokens = lex(text, lang)
                bad = next((t for t, _ in tokens if t.startswith("bad:")), None)
                if bad:
                    rows.append((file_id, lang, f"BOF {bad.split(' ')[0]}", [], [], [], []))
                    continue
                stream, marks, shapes = facts(tokens, lang)
                heads = [f"{a} {b}" for a, b in _siblings(tokens)] if lang == "python" else []
                rows.append((file_id, lang, " ".join(stream), heads, [sign[0] + kind for sign, kind in marks], list(shapes), list(_tops(tokens, lang))))
            if rows:
                yield pd.DataFrame(rows, columns=["file_id", "language", "tokens", "heads", "marks", "stmt", "top"])

    many = "array<string>"
    out = source.select("file_id", "language", "text").mapInPandas(run, f"file_id long, language string, tokens string, heads {many}, marks {many}, stmt {many}, top {many}")
    out = checkpoint(out)
    # adjacent tokens that no rule of the grammar permits; a file's distinct pairs are formed within its row
    row = out.select("file_id", "language", "heads", F.split("tokens", " ").alias("t"))
    n = F.size("t") - 1
    beside = F.zip_with(F.slice("t", 1, n), F.slice("t", 2, n), lambda x, y: F.concat(x, F.lit(" "), y))
    adjacent = row.select("file_id", "language", F.explode(F.array_distinct(F.concat(beside, "heads"))).alias("pair"))
    wrong = adjacent.join(F.broadcast(permissible(spark)), ["language", "pair"], "left_anti").select("file_id")
    # nesting
    by_file = Window.partitionBy("file_id").orderBy("seq")
    nest = out.select("file_id", F.posexplode("marks").alias("seq", "m")).select("file_id", "seq", F.when(F.col("m").startswith("o"), "open").otherwise("close").alias("tag"), F.substring("m", 2, 16).alias("left"))
    nest = nest.withColumn("d", F.sum(F.when(F.col("tag") == "open", 1).otherwise(-1)).over(by_file))
    nest = nest.withColumn("level", F.col("d") + F.when(F.col("tag") == "close", 1).otherwise(0))
    by_level = Window.partitionBy("file_id", "level").orderBy("seq")
    nest = nest.withColumns({"p_tag": F.lag("tag").over(by_level), "p_kind": F.lag("left").over(by_level), "n_tag": F.lead("tag").over(by_level)})
    closed = (F.col("tag") == "close") & (F.col("d") >= 0) & F.col("p_tag").eqNullSafe(F.lit("open")) & F.col("p_kind").eqNullSafe(F.col("left"))
    opened = (F.col("tag") == "open") & F.col("n_tag").eqNullSafe(F.lit("close"))
    broken = nest.filter(~(closed | opened)).select("file_id")
    # statement productions: the distinct shapes are few, whatever the number of files
    said = out.select("file_id", "language", F.lit("stmt").alias("tag"), F.explode("stmt").alias("left")).unionByName(out.select("file_id", "language", F.lit("top").alias("tag"), F.explode("top").alias("left")))
    shapes = said.select("language", "tag", "left").distinct()
    rules = [(lang, "stmt", _violations(lang).pattern, True) for lang in GRAMMARS] + [(lang, "top", rule, False) for lang, rule in TOPS.items()]
    violated = F.lit(False)
    for lang, tag, rule, bad in rules:
        hit = F.col("left").rlike(rule)
        violated = violated | ((F.col("language") == lang) & (F.col("tag") == tag) & (hit if bad else ~hit))
    odd = said.join(shapes.filter(violated), ["language", "tag", "left"], "left_semi").select("file_id")
    found = wrong.unionByName(broken).unionByName(odd).distinct()

    def confirm(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [not _parses(t, lang) for t, lang in zip(f["text"], f["language"])]
            if any(keep):
                yield f.loc[keep, ["file_id"]]

    if not exact:
        return source.select("file_id", "repo", "language").join(found.withColumn("bad", F.lit(True)), "file_id", "left").select("file_id", "repo", "language", F.col("bad").isNull().alias("valid"))
    suspects = source.join(found, "file_id", "left_semi").select("file_id", "language", "text")
    sure = suspects.mapInPandas(confirm, "file_id long").withColumn("bad", F.lit(True))
    return source.select("file_id", "repo", "language").join(sure, "file_id", "left").select("file_id", "repo", "language", F.col("bad").isNull().alias("valid"))


def _parses(text: str, lang: str) -> bool:
    """Exact parse where a parser is at hand; otherwise the finding stands."""
    try:
        if lang == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
            return True
        if lang == "json":
            json.loads(text, parse_constant=lambda c: 1 / 0)
            return True
    except (RecursionError, MemoryError):  # too deep for the parser: not known to be invalid
        return True
    except (SyntaxError, ValueError, ZeroDivisionError):
        return False
    return False


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The files that are not valid text of their language."""
    return invalid(table(spark, folder, "files"), table(spark, folder, "source_lines")).filter("NOT valid").select("file_id")


def p5_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The share of invalid files per repository and language."""
    judged = invalid(table(spark, folder, "files"), table(spark, folder, "source_lines"))
    bad = F.sum(F.when(F.col("valid"), 0).otherwise(1))
    return judged.groupBy("repo", "language").agg(F.count("*").alias("files"), bad.alias("invalid"), F.round(bad / F.count("*"), 6).alias("share"))


QUERIES = {"p5_found": p5_found, "p5_rates": p5_rates}
SQL: dict[str, str] = {}
