"""What to ask next, why nothing was found, and how hits are shown (driver side, over final rows)."""

from __future__ import annotations

import json
import shlex
from collections import OrderedDict
from collections.abc import Callable, Iterable

DECISIVE = 0.10
CACHED = 128


def follow_ups(hits: list[dict], symbol: str | None, full_identifier: str | None = None) -> list[str]:
    """Queries that would settle what the hits leave open; none if they are settled."""
    kinds = {k for h in hits for k in (h.get("contributors") or [h.get("kind")])}
    out = []
    name = symbol or next((h.get("symbol") for h in hits if h.get("symbol")), None)
    if name and "def" not in kinds:
        out.append(f"defs:{name}")
    if name and not kinds & {"caller", "graph"}:
        out.append(f"callers:{name}")
    if hits and name and (hits[0].get("margin") or 0) < DECISIVE * (hits[0].get("score") or 0):
        out.append(f"literal:{name}")
    if full_identifier:
        out.append(full_identifier)
    return list(OrderedDict.fromkeys(out))


def suggested(query: str, hits: list[dict], program: str = "siftspark") -> list[str]:
    """Commands to run next, quoted for a POSIX shell."""
    out = [f"{program} search {shlex.quote(q)}" for q in follow_ups(hits[:1], None)]
    if not any("embed" in (h.get("contributors") or []) for h in hits):
        out.append(f"{program} semantic {shlex.quote(query)}")
    out.append(f"{program} agent {shlex.quote(query)}")
    return [x for i, x in enumerate(out) if not i or x != out[i - 1]]


def diagnose(indexed: int, channel_down: bool, before_filters: int) -> str:
    """Why a search came back empty; the first reason that holds."""
    if not indexed:
        return "empty_index"
    if channel_down:
        return "channel_unavailable"
    return "filters_excluded_all" if before_filters else "no_match"


def line(hit: dict, width: int = 120) -> str:
    """One hit as one line of at most ``width`` bytes of excerpt."""
    text = (hit.get("excerpt") or "").split("\n", 1)[0].strip().encode()[:width].decode(errors="ignore")
    what = {"caller": f"{hit.get('caller')} -> {hit.get('callee')}", "graph": f"{hit.get('caller')} -> {hit.get('callee')}"}.get(hit["kind"], hit.get("symbol") or text)
    return f"{hit['file']}:{hit['line_start']}: [{hit['kind']}] {what}"


def why(hit: dict) -> list[str]:
    notes = [f"found by {c}" for c in hit.get("contributors") or []]
    notes += [f"{k} similarity {v:.3f}" for k, v in (hit.get("embed_fields") or {}).items() if v is not None]
    notes += [str(c) for c in (hit.get("critic") or [])] if isinstance(hit.get("critic"), list) else [str(hit["critic"])] if hit.get("critic") else []
    return [n for i, n in enumerate(notes) if not i or n != notes[i - 1]]


def budgeted(hits: Iterable[dict], budget: int) -> list[dict]:
    """Hits in rank order with as much detail as the byte budget allows, never beyond it."""
    out, left = [], budget
    for h in hits:
        base = {k: h[k] for k in ("file", "line_start", "kind") if k in h}
        full = h.get("excerpt") or ""
        for shown in (full, "\n".join(full.split("\n")[:6]), full.split("\n", 1)[0], None):
            row = base | ({"excerpt": shown} if shown is not None else {})
            size = len(json.dumps(row, ensure_ascii=False).encode())
            if size <= left:
                out.append(row)
                left -= size
                break
        else:
            break
    return out


def compact(hits: list[dict], snippet: int = 96) -> dict:
    """Paths interned once, short snippets."""
    paths: dict[str, str] = {}
    rows = []
    for h in hits:
        key = paths.setdefault(h["file"], _base36(_fnv(h["file"].encode()))[:6])
        rows.append([key, h["line_start"], h["kind"], (h.get("excerpt") or "").encode()[:snippet].decode(errors="ignore")])
    return {"paths": {v: k for k, v in paths.items()}, "hits": rows}


def cut(text: str, budget: int) -> str:
    """The text within a budget of bytes, cut at a character."""
    raw = text.encode()
    return text if len(raw) <= budget else raw[:budget].decode(errors="ignore")


def fold_roots(paths: list[str]) -> tuple[dict[str, str], list[str]]:
    """Common folders as short names, as long as the whole gets shorter: ``(roots, paths with them)``."""
    roots: dict[str, str] = {}
    now = list(paths)
    size = lambda r, p: len(json.dumps([r, p], ensure_ascii=False).encode())
    while True:
        heads = {p[: k + 1] for p in now for k, c in enumerate(p) if c == "/" and not p.startswith("@")}
        name = f"@{len(roots)}/"
        trials = [(size(roots | {name: h}, [name + p[len(h) :] if p.startswith(h) else p for p in now]), h) for h in sorted(heads)]
        if not trials or min(trials)[0] >= size(roots, now):
            return roots, now
        best = min(trials)[1]
        roots[name] = best
        now = [name + p[len(best) :] if p.startswith(best) else p for p in now]


def utf16(text: str, line: int, character: int) -> int:
    """The offset in ``text`` of an editor's position (line and UTF-16 unit, both from 0)."""
    lines = text.split("\n")
    line = max(0, min(line, len(lines) - 1))
    units, k = 0, 0
    for k, c in enumerate(lines[line]):
        if units >= character:
            break
        units += 2 if ord(c) > 0xFFFF else 1
    else:
        k = len(lines[line])
    return sum(len(x) + 1 for x in lines[:line]) + k


def identifier_at(text: str, offset: int) -> str | None:
    """The name that the offset stands in or behind."""
    word = lambda c: c.isalnum() or c in "_$"
    a = b = offset
    while a > 0 and word(text[a - 1]):
        a -= 1
    while b < len(text) and word(text[b]):
        b += 1
    return text[a:b] or None


def render(hits: list[dict], form: str = "native", query: str = "") -> str:
    if form == "lines":
        return "\n".join(line(h) for h in hits)
    if form == "agent":
        rows = [h | {"why": why(h)} for h in hits]
        return json.dumps({"query": query, "hits": rows, "follow_up_queries": follow_ups(hits, None), "suggested_next": suggested(query, hits)}, ensure_ascii=False)
    if form == "capsule":
        return json.dumps([{"ref": f"{h['file']}#L{h['line_start']}-L{h.get('line_end', h['line_start'])}", "preview": (h.get("excerpt") or "")[:120]} for h in hits], ensure_ascii=False)
    if form == "compact":
        return json.dumps(compact(hits), ensure_ascii=False)
    if form == "github":
        return json.dumps({"total_count": len(hits), "items": [{"path": h["file"], "name": h["file"].rsplit("/", 1)[-1], "score": h.get("score")} for h in hits]}, ensure_ascii=False)
    if form == "gitlab":
        return json.dumps([{"path": h["file"], "startline": h["line_start"], "data": h.get("excerpt")} for h in hits], ensure_ascii=False)
    return json.dumps({"query": query, "hits": hits}, ensure_ascii=False)


def _fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def _base36(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
    return out or "0"


class Responses:
    """The last responses, valid for one generation of the index."""

    def __init__(self, size: int = CACHED):
        self.size, self.held = size, OrderedDict()

    def get(self, key: tuple, generation: tuple, make: Callable[[], object]) -> object:
        k = (key, generation)
        if k not in self.held:
            self.held[k] = make()
            while len(self.held) > self.size:
                self.held.popitem(last=False)
        return self.held[k]


def run_plan(steps: list[dict], tools: dict[str, Callable], result: str | None = None):
    """Steps ``{id, tool, args}`` in order; ``$id.path`` in an argument stands for an earlier result."""
    done: dict[str, object] = {}

    def value(x):
        if isinstance(x, str) and x.startswith("$"):
            head, *rest = x[1:].split(".")
            at = done[head]
            for part in rest:
                at = at[int(part)] if isinstance(at, list) else at[part]
            return at
        if isinstance(x, dict):
            return {k: value(v) for k, v in x.items()}
        return [value(v) for v in x] if isinstance(x, list) else x

    for s in steps:
        done[s["id"]] = tools[s["tool"]](**value(s.get("args", {})))
    return value(result) if result else done[steps[-1]["id"]]
