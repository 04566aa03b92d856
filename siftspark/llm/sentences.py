"""Problem 10: sentence boundaries across languages and scripts.

The boundary rules are compiled into a finite transducer. Its input symbols are the
places of a text where anything can change: line starts by kind (blank, fence, heading,
bullet, number, text), paragraph ends, terminators by what surrounds them, quotation
marks by what precedes them, and blanks in Thai. Its state is the kind of block and of
open quotation; an output marks the end of a unit. All other characters leave the state
as it is and are skipped by the scanner.

A long text is cut into chunks at places where no mark can straddle the cut. A chunk
brings the whole words around it that its decisions look at, however long they are, and
the lines it touches are classified before the cut. Each chunk is read once for all
states: it becomes a function from entering to leaving state, and a list of possible unit
ends, each with the set of entering states that give it. The functions are composed by a
parallel prefix scan in two levels: in order within range partitions of (text, chunk),
then over one function a partition; so one text may span many tasks. The result does not
depend on where a text is cut. Short texts are one chunk and need no scan.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.session import checkpoint
from siftspark.sources.tables import table

CHUNK = 8_192

# Abbreviations whose dot never ends a sentence, those that do so only as titles (with a
# capital), and those whose dot may (fixed values).
NEVER = frozenset(
    "fig figs sec secs ch vol approx cf e.g i.e eg ie vs viz resp rev ver dept gen capt lt "
    "nr str abb kap bzw bzgl ca vgl d.h z.b u.a o.ä z.t i.d.r s.o s.u evtl ggf inkl exkl zzgl tel "
    "env ex p.ex art chap "
    "aprox ej p.ej pág págs núm cap "
    "ок т.е напр см рис гл стр г-н г-жа "
    "श्री डॉ सुश्री प्रो د".split()
)
TITLES = frozenset("mr mrs ms dr prof col sgt st mt ave hr fr m mm mme mlle sr sra srta ud uds dra".split())
MAYBE = frozenset("etc a.m p.m usw u.s inc ltd corp co jr usf u.k e.u d.c т.д т.п и.т.д и.т.п др пр al".split())
DETERMINERS = frozenset("der die das den dem des am im zum zur beim vom ab seit bis vor nach ein eine einem einen jeder jede jedes ins ans".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez".split())
# Words after which a single capital letter is the initial of a name (fixed values).
LINKS = frozenset("by of from with and & to for von mit und an par de et avec pour por con y e del para".split())

_CLOSE = r"(?:[ \u00a0\u202f]?\u00bb|[\"'\u201c\u201d\u2019\u203a)\]\u300d\u300f\u3011\uff09\u3015\u3009\uff63*`])*"
_MARK = re.compile(r"[.!?…؟۔।॥。！？｡．“„«‹「『｢”»›」』｣\"](?:(?<!\.)|(?!\w))")
_CJK = re.compile(r"[。！？｡．]+[.!?…。！？｡]*([\"'”’›»)\]」』】）》〉｣]*)")
_TERM = re.compile(r"[.!?…؟۔।॥]+(" + _CLOSE + r")(?=\s|\Z)")
_INNER = re.compile(r"[.!?…؟۔।॥]+([\"”»›」』])")
_GAP = re.compile(r"(?<=\S)[ \t 　]+(?=\S)")
_THAI = re.compile(r"[ก-๏]")
_FENCE = re.compile(r"[ \t]{0,3}(?:```|~~~)")
_HEAD = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_BULLET = re.compile(r"[ \t]*[-*+•‣◦][ \t]+\S")
_NUMBER = re.compile(r"[ \t]*\d{1,3}[.)][ \t]+\S")
_SOLID = re.compile(r"\S")
_WORD = re.compile(r"\S+")
_BREAK = re.compile(r"\n[^\S\n]*\n")
_LETTERS = re.compile(r"[^\W\d_]+")
_QUOTES = frozenset("\"”“’»›」』｣")
_OPENERS = "([（\"“„«‹「『'‘*`"
_LEAD = re.compile("[" + re.escape(_OPENERS + "¿¡") + "   ]*")
_IDENT = re.compile(r"[\w.$/\\-]*(?:_|\(|/|::|\\)[\w.$/\\()-]*")
_SAFE = re.compile(r"\n|(?<=\w)[ \t](?=\w)|(?<=\w\w)(?=\w\w)")

START, PARA, LIST, FENCE = range(4)
NONE, AT_START, AFTER_COLON, INSIDE = range(4)
SYMBOLS = "blank fence head bullet number text last thai eof end quote_end quote_cjk quote_no open_start open_colon open_inside shut".split()
SYM = {s: i for i, s in enumerate(SYMBOLS)}
_OPEN, _SHUT = frozenset(SYM[s] for s in ("open_start", "open_colon", "open_inside")), frozenset(SYM[s] for s in ("shut", "quote_end", "quote_cjk", "quote_no"))
_LINES = frozenset(SYM[s] for s in ("blank", "fence", "head", "bullet", "last", "eof"))


def _step(block: int, quote: int, sym: str) -> tuple[int, int, int]:
    if sym == "fence":
        return (START, NONE, 1) if block == FENCE else (FENCE, NONE, 0)
    if block == FENCE:
        return FENCE, NONE, int(sym == "eof")
    if sym == "blank":
        return START, NONE, 0
    if sym == "head":
        return START, NONE, 1
    if sym == "bullet" or sym == "number" and block != PARA:
        return LIST, NONE, 1
    if sym in ("text", "number"):
        return (PARA, quote, 0) if block == PARA else (PARA, NONE, 0)
    if block != PARA or sym == "eof":
        return block, quote, 0
    if sym == "last":
        return PARA, NONE, 1
    if sym == "thai":
        return PARA, quote, 1
    if sym == "end":
        return PARA, quote, int(quote == NONE)
    if sym == "quote_end":
        return PARA, NONE, 1
    if sym == "quote_cjk":
        return PARA, NONE, int(quote == AFTER_COLON)
    if sym in ("quote_no", "shut"):
        return PARA, NONE, 0
    kind = {"open_start": AT_START, "open_colon": AFTER_COLON, "open_inside": INSIDE}[sym]
    return PARA, quote if quote != NONE else kind, 0


STATES = 16
_TABLE = [[_step(s // 4, s % 4, sym) for sym in SYMBOLS] for s in range(STATES)]
NEXT = [[b * 4 + q for b, q, _ in row] for row in _TABLE]
OUT = [[o for _, _, o in row] for row in _TABLE]
IDENTITY = list(range(STATES))


def _kind(line: str) -> str:
    if not line or line.isspace():
        return "blank"
    c = line.lstrip()[0]
    if c in "`~" and _FENCE.match(line):
        return "fence"
    if c == "#" and _HEAD.match(line):
        return "head"
    if c in "-*+•‣◦" and _BULLET.match(line):
        return "bullet"
    return "number" if c.isdigit() and _NUMBER.match(line) else "text"


def _starts(text: str, at: int, strong: bool) -> bool:
    """Can what stands at ``at`` begin a sentence? ``strong``: only if it cannot be a continuation either."""
    c = text[at]
    if c in _OPENERS and at + 1 < len(text):
        inner = _LEAD.match(text, at).end()
        return inner >= len(text) or not text[inner].islower() or bool(_IDENT.match(text, inner))
    if c.islower() or c.isdigit():
        return not strong
    return c not in ".…,;:)]}»”’،؛،、，；：-–—%/=+<>|&"


def _name(text: str, at: int) -> bool:
    """Does a program name (with a mark of code in it) stand at ``at``?"""
    m = _IDENT.match(text, at)
    return bool(m) and m.end() <= _WORD.match(text, at).end()


def _before(text: str, at: int) -> list[str]:
    """The last words before ``at`` in its paragraph: three, or all there are."""
    reach = 48
    while True:
        lo = max(0, at - reach)
        near = text[lo:at]
        blank = list(_BREAK.finditer(near))
        parts = near[blank[-1].end() if blank else 0 :].split()
        if not lo or blank or len(parts) > 3:
            return parts if not lo or blank else parts[1:]
        reach *= 4


def _ends(text: str, at: int, mark: str, closers: str, nxt: int, quoted: bool) -> bool:
    """Does the terminator at ``at`` end a sentence that the text from ``nxt`` on could follow?"""
    if quoted and text[nxt].islower():  # the sentence around the quotation goes on, unless a name begins the next
        return _name(text, nxt)
    if mark != ".":
        return _starts(text, nxt, mark == "…" or set(mark) == {"."})
    if not at or text[at - 1].isspace():
        return False
    parts = _before(text, at)
    own = parts[-1].lstrip("([{\"'“„«‹「『¿¡*`")
    word = own.lower()
    if not closers.strip("*`"):
        prev = parts[-2] if len(parts) > 1 else ""
        amount = prev[-1:].isdigit()  # a unit of measure stands after its number
        if len(word) == 1 and word.isalpha() and (word.isascii() or "Ѐ" <= word <= "ԯ"):
            if prev.lower() in ("т.", "и"):
                return word in "дп" and _starts(text, nxt, True)
            if amount:
                return _starts(text, nxt, own.islower() and text[nxt].isdigit())
            return own.isupper() and _plain_letter(prev, parts) and _starts(text, nxt, True)
        if word in NEVER or word == "no" and text[nxt].isdigit():
            return False
        if word in TITLES and own[:1].isupper() and not amount:
            return False
        if word in MAYBE:
            return _starts(text, nxt, True) or text[nxt].islower() and _name(text, nxt)
        if word.isdigit() and len(word) <= 3:
            follow = _LETTERS.match(text, nxt)
            if follow and (follow.group().lower() in MONTHS or prev.lower().strip("(„\"") in DETERMINERS):
                return False
    return _starts(text, nxt, False)


def _plain_letter(prev: str, parts: list[str]) -> bool:
    """Is a single capital letter after ``prev`` the end of a noun ("vitamin C") rather than an initial?"""
    bare = prev.strip("([{\"'“„«‹*`.,;:")
    return bool(bare) and bare[0].islower() and len(bare) > 1 and prev[-1:] not in ".,;:" and bare.lower() not in LINKS


def lines_of(text: str) -> list[tuple[int, int, int, str, bool]]:
    """``(start, end, end without white space, kind, holds Thai)`` of every line."""
    out, a = [], 0
    thai = bool(_THAI.search(text))
    for line in text.split("\n"):
        e = a + len(line)
        out.append((a, e, a + len(line.rstrip()), _kind(line), thai and bool(_THAI.search(line))))
        a = e + 1
    return out


def line_events(rows: list[tuple[int, int, int, str, bool]], n: int) -> list[tuple[int, int, int]]:
    """``(position, symbol, unit end)`` of line starts, paragraph ends and the end of the text."""
    out: list[tuple[int, int, int]] = []
    for i, (a, e, end, kind, thai) in enumerate(rows):
        if a < n or not a:
            out.append((a, SYM[kind], end))
        if kind in ("text", "number"):
            nxt = rows[i + 1][3] if i + 1 < len(rows) else "eof"
            if nxt not in ("text", "number"):
                out.append((e, SYM["last"], end))
            elif thai:  # Thai lines end sentences
                out.append((e, SYM["thai"], end))
    last = next((end for _, _, end, kind, _ in reversed(rows) if kind != "blank"), 0)
    out.append((n + 1, SYM["eof"], last))
    return out


def mark_events(text: str, lo: int, hi: int, thai: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(position, symbol, unit end)`` of the marks that begin in ``text[lo:hi]``.

    ``thai`` are the ranges of the lines that hold Thai. Decisions look at whole words before
    and behind, so ``text`` must hold those around ``lo`` and ``hi``.
    """
    out: list[tuple[int, int, int]] = []
    done, n = lo, len(text)
    for m in _MARK.finditer(text, lo, min(n, hi)):
        at = m.start()
        if at < done:
            continue
        c = text[at]
        if c in ".!?…؟۔।॥":
            t = _TERM.match(text, at)
            if t is None:
                t = _INNER.match(text, at)
                if t is not None:
                    done = t.end()
                    if t.group(1) != '"' or not (at and text[at - 1].isspace()):
                        out.append((at, SYM["quote_no"], done))
                continue
            done, closers, cjk = t.end(), t.group(1), False
        elif c in "。！？｡．":
            t = _CJK.match(text, at)
            done, closers, cjk = t.end(), t.group(1), True
        else:
            done = at + 1
            if c == '"':
                before = text[at - 1] if at else " "
                opens = before.isspace() or before in "([{（-—–/:：="
            else:
                opens = c in "“„«‹「『｢" and not (c == "“" and at and not text[at - 1].isspace() and (at + 1 >= n or text[at + 1].isspace() or text[at + 1] in ".,;:!?)"))  # also the closing mark of German
            if not opens:
                out.append((at, SYM["shut"], at + 1))
            else:
                before = _before(text, at)
                last = before[-1][-1] if before else ""
                where = "open_colon" if last in (":", "：") else "open_start" if not last or last in ".!?…。！？؟।\"”»」』)）" else "open_inside"
                out.append((at, SYM[where], at))
            continue
        quoted = any(x in _QUOTES for x in closers) and closers not in ("’", "'")
        solid = _SOLID.search(text, done)
        if solid is None:  # the end of the text; the line gives the unit
            if quoted:
                out.append((at, SYM["quote_no"], done))
            continue
        nxt = solid.start()
        if cjk:
            if quoted:
                out.append((at, SYM["quote_no" if text[nxt] in "，、；：,;と" else "quote_cjk"], done))
            elif text[nxt] not in "，、；：,;":
                out.append((at, SYM["end"], done))
        elif _ends(text, at, t.group()[: len(t.group()) - len(closers)], closers, nxt, quoted):
            out.append((at, SYM["quote_end" if quoted else "end"], done))
        elif quoted:
            out.append((at, SYM["quote_no"], done))
    for a, e in thai:
        for m in _GAP.finditer(text, max(a, lo), min(e, n)):
            if m.start() < hi:
                out.append((m.start(), SYM["thai"], m.start()))
    return out


def unclosed(evs: list[tuple[int, int, int]], closes: bool) -> list[tuple[int, int, int]]:
    """The events without the opening marks that nothing in their paragraph closes.

    ``closes``: is the next mark or paragraph end behind these events a closing mark?
    """
    out = []
    for e in reversed(evs):
        if e[1] in _SHUT:
            closes = True
        elif e[1] in _LINES:
            closes = False
        if closes or e[1] not in _OPEN:
            out.append(e)
    out.reverse()
    return out


def first_sign(evs: list[tuple[int, int, int]]) -> int:
    """1 if the first closing mark of these events comes before a paragraph end, 0 if behind, -1 if there is neither."""
    return next((int(e[1] in _SHUT) for e in evs if e[1] in _SHUT or e[1] in _LINES), -1)


def function(evs: list[tuple[int, int, int]]) -> list[int]:
    """The chunk as a function from entering to leaving state."""
    f = IDENTITY
    for _, sym, _ in evs:
        f = [NEXT[s][sym] for s in f]
    return f


def outputs(evs: list[tuple[int, int, int]]) -> tuple[list[int], list[int], list[int]]:
    """The function of a chunk, its possible unit ends, and for each the entering states (as bits) that give it."""
    f, ends_, masks = IDENTITY, [], []
    for _, sym, end in evs:
        mask = sum(1 << s for s in IDENTITY if OUT[f[s]][sym])
        if mask and end > 0:
            ends_.append(end)
            masks.append(mask)
        f = [NEXT[s][sym] for s in f]
    return f, ends_, masks


def run(evs: list[tuple[int, int, int]], state: int) -> list[int]:
    """The unit ends that the transducer gives for these events."""
    out = []
    for _, sym, end in evs:
        if OUT[state][sym]:
            out.append(end)
        state = NEXT[state][sym]
    return out


def normalise(text: str) -> str:
    """Line ends as line feeds, at equal positions (a carriage return before one becomes a blank)."""
    if "\r" in text:
        text = text.replace("\r\n", " \n").replace("\r", "\n")
    return text


def cuts(text: str, size: int) -> list[int]:
    """Where a long text is cut: behind a line feed or a single blank between words, else within a word."""
    out, at, n = [0], 0, len(text)
    while n - at > size:
        k = text.rfind("\n", at + size // 2, at + size) + 1
        if not k:
            m = _SAFE.search(text, at + size)
            k = m.end() if m else n
        if k >= n:
            break
        out.append(k)
        at = k
    return out


def _words_around(text: str, a: int, b: int, many: int = 4) -> tuple[int, int]:
    """The range that holds ``text[a:b]`` and ``many`` whole words on both sides."""
    lo, reach = a, 64
    while lo > 0:
        lo = max(0, a - reach)
        if len(text[lo:a].split()) > many + 1:
            break
        reach *= 4
    hi = b
    for _ in range(many):
        m = _WORD.search(text, hi)
        hi = m.end() if m else len(text)
    return lo, hi


def pieces(text: str, size: int) -> Iterator[tuple[int, int, int, int, str, list, list]]:
    """The chunks of a text: ``(number, base, from, to, window, line events, Thai ranges)``, positions of the text."""
    rows, at = lines_of(text), cuts(text, size)
    of_lines, n = line_events(rows, len(text)), len(text)
    place, begin = [e[0] for e in of_lines], [r[0] for r in rows]
    for k, a in enumerate(at):
        b = at[k + 1] if k + 1 < len(at) else n
        lo, hi = _words_around(text, a, b)
        own = of_lines[bisect.bisect_left(place, a) : bisect.bisect_left(place, b) if b < n else None]
        touched = rows[max(0, bisect.bisect_right(begin, a) - 1) : bisect.bisect_left(begin, b)]
        yield k, lo, a, b, text[lo:hi], own, [(r[0], r[1]) for r in touched if r[4]]


def _chunk_events(base: int, a: int, b: int, window: str, own: list, thai: list) -> list[tuple[int, int, int]]:
    """The events of a chunk in order, with positions of the text."""
    marks = mark_events(window, a - base, b - base, [(x - base, y - base) for x, y in ((max(x, base), y) for x, y in thai)])
    evs = [*map(tuple, own), *((p + base, s, e + base) for p, s, e in marks)]
    evs.sort(key=lambda x: x[0])
    return evs


def ends(text: str) -> list[int]:
    """All unit ends of one text that is not cut."""
    text = normalise(text)
    rows, n = lines_of(text), len(text)
    evs = line_events(rows, n) + mark_events(text, 0, n, [(r[0], r[1]) for r in rows if r[4]])
    evs.sort(key=lambda x: x[0])
    return sorted({e for e in run(unclosed(evs, False), START * 4) if e > 0})


def ends_by_chunks(text: str, size: int = CHUNK) -> list[int]:
    """The same by chunk functions, as the distributed form computes it."""
    text, out, state = normalise(text), set(), START * 4
    chunks = [_chunk_events(*p[1:]) for p in pieces(text, size)]
    signs = [first_sign(e) for e in chunks]
    for k, evs in enumerate(chunks):
        f, found, masks = outputs(unclosed(evs, next((s for s in signs[k + 1 :] if s >= 0), 0) == 1))
        out |= {e for e, m in zip(found, masks) if m >> state & 1}
        state = f[state]
    return sorted(out)


def units(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK) -> DataFrame:
    """One row per unit: ``<key>, end_pos``, the number of characters up to the unit's end.

    Null keys or texts, empty texts and texts of white space have no unit. Repeated rows of
    a key give each end once. Texts are read whole, whatever their length. Extra columns are
    ignored; an empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    id_type = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).filter("id IS NOT NULL AND t IS NOT NULL AND t <> ''")
    short = source.filter(F.length("t") <= size)
    long = source.filter(F.length("t") > size)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.DataFrame({"id": f["id"], "e": [ends(t) for t in f["t"]]})

    done = short.mapInPandas(whole, f"id {id_type}, e array<long>").select(F.col("id").alias(key), F.explode("e").alias("end_pos"))

    # a key with two different texts keeps both apart by a hash of the text
    tagged = long.withColumn("part", F.xxhash64("t")).dropDuplicates(["id", "part"])

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, t, part in f[["id", "t", "part"]].itertuples(index=False):
                for k, base, a, b, w, own, thai in pieces(normalise(t), size):
                    yield pd.DataFrame({"id": [i], "part": [part], "k": [k], "base": [base], "a": [a], "b": [b], "w": [w], "own": [[x for e in own for x in e]], "thai": [[x for e in thai for x in e]]})

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                own, thai = [int(x) for x in r.own], [int(x) for x in r.thai]
                evs = _chunk_events(r.base, r.a, r.b, r.w, list(zip(own[::3], own[1::3], own[2::3])), list(zip(thai[::2], thai[1::2])))
                both = [outputs(unclosed(evs, closes)) for closes in (False, True)]
                out.append((r.id, r.part, r.k, first_sign(evs), both[0][0], both[1][0], both[0][1], both[0][2], both[1][1], both[1][2]))
            if out:
                yield pd.DataFrame(out, columns=["id", "part", "k", "sign", "f0", "f1", "e0", "m0", "e1", "m1"])

    # a chunk is read for both answers to "does a closing mark follow?"; the text is not kept
    placed = tagged.mapInPandas(split, f"id {id_type}, part long, k int, base long, a long, b long, w string, own array<long>, thai array<long>").repartition("id", "part", "k")
    placed = placed.mapInPandas(read, f"id {id_type}, part long, k int, sign int, f0 array<int>, f1 array<int>, e0 array<long>, m0 array<int>, e1 array<long>, m1 array<int>")
    placed = checkpoint(placed.repartitionByRange("id", "part", "k").sortWithinPartitions("id", "part", "k").withColumn("p", F.spark_partition_id()))

    def scan_back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row a partition: its first text, that text's first sign, whether it is one text only."""
        head, sign, p, single = None, -1, None, True
        for f in frames:
            for r in f.itertuples(index=False):
                if head is None:
                    head, p = (r.id, r.part), r.p
                if (r.id, r.part) != head:
                    single = False
                    break
                if sign < 0:
                    sign = r.sign
        if head is not None:
            yield pd.DataFrame({"p": [p], "id": [head[0]], "part": [head[1]], "sign": [sign], "single": [single]})

    heads = {r["p"]: r for r in placed.select("id", "part", "k", "sign", "p").mapInPandas(scan_back, f"p int, id {id_type}, part long, sign int, single boolean").collect()}  # one row a partition
    follows, behind = {}, None
    for p in sorted(heads, reverse=True):
        follows[p] = behind  # (text, sign) that stands behind this partition
        r = heads[p]
        key_ = (r["id"], r["part"])
        sign = r["sign"] if r["sign"] >= 0 else behind[1] if r["single"] and behind and behind[0] == key_ else -1
        behind = (key_, sign)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each chunk with the composition of the functions of its text before it in the partition."""
        rows = [r for f in frames for r in f.itertuples(index=False)]  # functions and ends only
        nxt, closes = None, []
        for r in reversed(rows):
            if nxt is None or nxt[0] != (r.id, r.part):
                after = follows.get(r.p) if nxt is None else None
                nxt = ((r.id, r.part), after[1] if after and after[0] == (r.id, r.part) else -1)
            closes.append(nxt[1] == 1)
            if r.sign >= 0:
                nxt = (nxt[0], r.sign)
        closes.reverse()
        out, now, before = [], None, IDENTITY
        for r, c in zip(rows, closes):
            if (r.id, r.part) != now:
                now, before = (r.id, r.part), IDENTITY
            out.append((r.id, r.part, r.k, r.p, list(before), r.e1 if c else r.e0, r.m1 if c else r.m0))
            g = r.f1 if c else r.f0
            before = [int(g[s]) for s in before]
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["id", "part", "k", "p", "f", "e", "m"])
                out = []
        if now is not None:
            out.append((rows[-1].id, rows[-1].part, -1, rows[-1].p, list(before), [], []))  # what the partition's last text has become
            yield pd.DataFrame(out, columns=["id", "part", "k", "p", "f", "e", "m"])

    scanned = checkpoint(placed.mapInPandas(scan, f"id {id_type}, part long, k int, p int, f array<int>, e array<long>, m array<int>"))
    tails = sorted((r["p"], r["id"], r["part"], r["f"]) for r in scanned.filter("k < 0").select("p", "id", "part", "f").collect())  # one row a partition
    entering, carried = [], None
    for p, i, part, f in tails:
        own = (heads[p]["id"], heads[p]["part"])
        state = carried[1] if carried and carried[0] == own else START * 4
        entering.append((int(p), *own, int(state)))
        carried = ((i, part), f[state] if heads[p]["single"] else f[START * 4])
    states = F.broadcast(spark.createDataFrame(entering, f"__p int, __id {id_type}, __part long, s int"))
    joined = scanned.filter("k >= 0").join(states, (F.col("p") == F.col("__p")) & (F.col("id") == F.col("__id")) & (F.col("part") == F.col("__part")), "left")
    state = F.element_at("f", F.coalesce("s", F.lit(START * 4)) + 1)
    hits = joined.withColumn("s0", state).select("id", "s0", F.inline(F.arrays_zip("e", "m")))
    cut = hits.filter("(shiftright(m, s0) & 1) = 1").select(F.col("id").alias(key), F.col("e").alias("end_pos"))
    return done.unionByName(cut).filter("end_pos > 0").distinct()


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The end of every unit of every document."""
    return units(table(spark, folder, "documents"))


QUERIES = {"p10_found": p10_found}
SQL: dict[str, str] = {}
