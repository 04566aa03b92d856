"""The tool surface: a catalogue with schemas, single and batched calls, a session, and a command line."""

from __future__ import annotations

import json
import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from siftspark.operators import graph, structure, symbols, text
from siftspark.plans import index, planner, search
from siftspark.plans.query import QueryError
from siftspark.sources import files as store
from siftspark.streaming import generations

PARALLEL = 4  # read-only calls from which a batch runs side by side

_STRING, _NUMBER = {"type": "string"}, {"type": "integer", "minimum": 1}


def _tool(what: str, required: dict, optional: dict | None = None, writes: bool = False) -> dict:
    return {"description": what, "read_only": not writes, "input_schema": {"type": "object", "properties": {**required, **(optional or {})}, "required": sorted(required), "additionalProperties": False}}


_PAGE = {"limit": _NUMBER, "language": _STRING, "glob": _STRING}
CATALOG = {
    "keyword_search": _tool("Lines, definitions and calls for a free or prefixed query", {"query": _STRING}, _PAGE),
    "semantic_search": _tool("Chunks by meaning", {"query": _STRING}, _PAGE),
    "pattern_search": _tool("Nodes of a structural pattern", {"pattern": _STRING}, _PAGE),
    "definitions": _tool("Where a name is defined", {"name": _STRING}, _PAGE),
    "callers": _tool("Who calls a name", {"name": _STRING}, _PAGE),
    "imports": _tool("Which files import a module", {"module": _STRING}, _PAGE),
    "code_read": _tool("A window of lines of a file", {"file": _STRING, "start": _NUMBER, "end": _NUMBER}, {"around": {"type": "integer", "minimum": 0}, "budget": _NUMBER}),
    "chain": _tool("Files around a name along calls", {"name": _STRING}, {"depth": _NUMBER}),
    "call_path": _tool("A shortest path of calls between two names", {"start": _STRING, "goal": _STRING}),
    "filter_hits": _tool("Hits of some kinds, paths or scores", {"query": _STRING}, _PAGE | {"kinds": {"type": "array", "items": _STRING}, "min_score": {"type": "number"}}),
    "index_status": _tool("The index's generation and rows", {}),
    "index_repo": _tool("Build and publish the index of a data folder", {"folder": _STRING}, writes=True),
}


def check(tool: str, args: dict) -> None:
    """Refuse arguments that the tool's schema does not allow, with a hint where a name is nearly right."""
    if tool not in CATALOG:
        raise QueryError(f"no tool {tool!r}; nearest: {nearest(tool, list(CATALOG))}")
    schema = CATALOG[tool]["input_schema"]
    for name in schema["required"]:
        if name not in args:
            raise QueryError(f"{tool} needs {name}")
    kinds = {"string": str, "integer": int, "number": (int, float), "array": list}
    for name, value in args.items():
        if name not in schema["properties"]:
            raise QueryError(f"{tool} takes no {name!r}; nearest: {nearest(name, list(schema['properties']))}")
        rule = schema["properties"][name]
        if not isinstance(value, kinds[rule["type"]]) or isinstance(value, bool) or value == "":
            raise QueryError(f"{tool}: {name} must be of type {rule['type']} and not empty")
        if rule["type"] == "integer" and value < rule["minimum"]:
            raise QueryError(f"{tool}: {name} must be at least {rule['minimum']}")


def distance(a: str, b: str) -> int:
    """Edits between two short names."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(name: str, known: list[str]) -> str | None:
    best = min(known, key=lambda k: (distance(name.lower(), k.lower()), k), default=None)
    return best if best is not None and distance(name.lower(), best.lower()) <= max(2, len(best) // 3) else None


@dataclass
class Session:
    """A reader of one index: tools, remembered responses, excerpts shown once, and a ledger."""

    spark: SparkSession
    root: str
    ledger: str | None = None
    responses: planner.Responses = field(default_factory=planner.Responses)
    shown: set = field(default_factory=set)

    def call(self, tool: str, **args):
        check(tool, args)
        if not CATALOG[tool]["read_only"]:
            return index.build(self.spark, args["folder"], self.root)
        held = index.open_index(self.spark, self.root)
        out = self.responses.get((tool, json.dumps(args, sort_keys=True)), (held.generation,), lambda: self._run(held, tool, args))
        if self.ledger:
            note(self.ledger, args.get("query", tool), len(out) if isinstance(out, list) else 1, len(json.dumps(out, default=str)))
        return out

    def _run(self, held: index.Index, tool: str, args: dict):
        options = search.Options(limit=args.get("limit"), language=args.get("language"), glob=args.get("glob"))
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731 - a page
        prefix = {"definitions": "defs:", "callers": "callers:", "imports": "imports:"}
        if tool in prefix:
            return rows(search.search(held, prefix[tool] + next(args[k] for k in ("name", "module") if k in args), options))
        if tool == "keyword_search":
            return rows(search.search(held, args["query"], options))
        if tool == "semantic_search":
            query = search.Query(args["query"], "semantic", args["query"], ())
            return rows(search.channel(held, query, options).limit(search.limit(options.limit)))
        if tool == "pattern_search":
            hits = structure.lookup(held.nodes, args["pattern"]) if "nodes" in generations.pointer(self.spark, self.root)["tables"] else None
            if hits is None:
                raise QueryError("the index holds no pattern nodes for this pattern")
            return rows(hits.limit(search.limit(options.limit)))
        if tool == "filter_hits":
            page = search.search(held, args["query"], options)
            return rows(search.filter_hits(page, args.get("kinds"), None, args.get("min_score")))
        if tool == "code_read":
            window = text.read_node(held.lines, args["file"], args["start"], args["end"], args.get("around", 0))
            return self.elide(args["file"], args["start"], planner.cut("\n".join(r["content"] for r in window.collect()), args.get("budget", 1 << 16)))
        if tool == "chain":
            seeds = held.symbols.filter(symbols.same_name(search.F.col("name"), args["name"])).select(search.F.col("path").alias("file"), search.F.lit(1.0).alias("score")).distinct()
            return rows(graph.chain(seeds, graph.file_edges(held.calls, held.symbols), args.get("depth", graph.DEPTH)))
        if tool == "call_path":
            return rows(graph.hops(graph.call_path(held.calls, held.symbols, args["start"], args["goal"]), held.symbols))
        return generations.status(self.spark, self.root)

    def elide(self, file: str, start: int, shown: str) -> str:
        """A text that this session has shown already is given as one mark."""
        key = (file, start, shown)
        if key in self.shown:
            return "~"
        self.shown.add(key)
        return shown

    def batch(self, calls: list[dict]) -> list[dict]:
        """Results in order, an error beside its call; many read-only calls run side by side."""

        def one(c: dict) -> dict:
            try:
                return {"id": c.get("id"), "ok": True, "result": self.call(c["tool"], **c.get("args", {}))}
            except Exception as error:  # noqa: BLE001 - one call's failure is its own
                return {"id": c.get("id"), "ok": False, "error": str(error).split("\n", 1)[0]}

        if len(calls) >= PARALLEL and all(CATALOG.get(c.get("tool"), {}).get("read_only") for c in calls):
            with ThreadPoolExecutor(PARALLEL) as pool:
                return list(pool.map(one, calls))
        return [one(c) for c in calls]


def note(path: str, query: str, hits: int, size: int) -> None:
    """Append one line to a ledger below the working folder; a failure only warns."""
    try:
        full = os.path.realpath(path)
        if not os.path.isabs(path) or ".." in path.split("/") or not full.startswith(os.path.realpath(os.getcwd()) + os.sep):
            raise OSError("the ledger must be an absolute path below the working folder")
        with open(full, "a", encoding="utf-8") as out:
            out.write(json.dumps({"ts": round(time.time(), 3), "query": query, "hits": hits, "bytes": size}) + "\n")
    except OSError as error:
        print(f"ledger: {error}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    """``capabilities``, ``status ROOT``, ``build FOLDER ROOT``, ``doctor ROOT``, or ``TOOL ROOT key=value ...``."""
    from siftspark.session import local_session

    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv[0] == "capabilities":
        print(json.dumps(CATALOG))
        return 0
    spark = SparkSession.getActiveSession() or local_session()
    command, *rest = argv
    try:
        if command == "build":
            print(json.dumps({"generation": index.build(spark, rest[0], rest[1])}))
        elif command == "status":
            print(json.dumps(generations.status(spark, rest[0])))
        elif command == "doctor":
            print(json.dumps({"generation": generations.recover(spark, rest[0]), "pointer": store.exists(spark, f"{rest[0]}/_CURRENT")}))
        else:
            pairs = dict(x.split("=", 1) for x in rest[1:])
            rules = CATALOG.get(command, {}).get("input_schema", {}).get("properties", {})
            args = {k: int(v) if rules.get(k, {}).get("type") == "integer" else v.split(",") if rules.get(k, {}).get("type") == "array" else v for k, v in pairs.items()}
            print(json.dumps(Session(spark, rest[0] if rest else "").call(command, **args), default=str))
    except (QueryError, generations.IdentityError, IndexError, ValueError) as error:
        print(json.dumps({"error": str(error) or type(error).__name__}))
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
