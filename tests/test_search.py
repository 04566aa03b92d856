"""Searches as they are run: the published index, modes, conjunctions, finish, tools, functions, rewriting."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.functions import udfs
from siftspark.functions.prefix import numbered
from siftspark.operators import chunks, conjunction, evaluate, extract, graph, lexical, structure, symbols, vectors
from siftspark.plans import index, planner, search, tools
from siftspark.plans import query as q
from siftspark.sources import corpus, facts
from siftspark.streaming import generations

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    index.build(spark, SF, folder)
    return folder


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("test", [lambda c: c.contains("retry"), lambda c: c.rlike(r"\btoken\b"), lambda c: c.rlike("return [0-9]+")])
def test_filters_stand_below_the_removal_of_repeats(spark, test):
    """No line is shuffled before it matches: in the plan the filter on the text is under every aggregate."""
    plan = _plan(facts.lines(spark, SF).filter(test(F.col("content")))).split("\n")
    depth = {what: [i for i, x in enumerate(plan) if what in x and re.search(r"\bcontent#", x)] for what in ("Aggregate", "Filter")}
    assert depth["Filter"] and depth["Aggregate"] and max(depth["Aggregate"]) < max(depth["Filter"])


def test_postings_need_no_shuffle(spark):
    lines = spark.createDataFrame([("a", 1, "x y x"), ("a", 2, ""), ("b", 1, "y_z Y")], "path string, line_no int, content string")
    got = lexical.postings(lines)
    assert "Aggregate" not in _plan(got)
    assert sorted((r.term, r.path, r.line_no, r.tf, r.dl) for r in got.collect()) == [("x", "a", 1, 2, 3), ("y", "a", 1, 1, 3), ("y", "b", 1, 1, 2), ("y_z", "b", 1, 1, 2)]


def test_index_answers_like_the_tables(spark, root):
    held, raw = index.open_index(spark, root), index.over(spark, SF)
    for text in ("defs:parse", "callers:render", "literal:retry", "word:token", "imports:kit", "literal:retry AND NOT defs:parse"):
        a, b = ([tuple(r) for r in search.search(ix, text).select("position", "kind", "file", "line_start", "score").orderBy("position").collect()] for ix in (held, raw))
        assert a == b, text
    best = [tuple(r) for r in held.bm25(["retry", "window"]).collect()]
    assert best == [tuple(r) for r in lexical.bm25(raw.lines, ["retry", "window"]).collect()]
    with pytest.raises(generations.IdentityError):
        index.open_index(spark, root, "another model")
    with pytest.raises(q.QueryError):
        search.search(held, "defs:")


def test_generations_are_strict_and_recover(spark, tmp_path):
    where, one = str(tmp_path / "g"), spark.createDataFrame([("a", "h")], "path string, content_hash string")
    assert generations.recover(spark, where) == 0 and generations.publish(spark, where, {"files": one}) == 1
    with pytest.raises(generations.StrictError):
        generations.publish(spark, where, {"files": one}, failed=one)
    assert generations.current(spark, where) == 1 and generations.publish(spark, where, {"files": one}, failed=one.limit(0)) == 2
    for part in (tmp_path / "g" / "generation=2" / "files").glob("*.parquet"):
        part.write_bytes(b"damaged")
    assert generations.recover(spark, where) == 1 and (tmp_path / "g" / "quarantine=2").exists()
    assert generations.status(spark, where)["rows"] == {"files": 1}


def test_change_kinds(spark):
    text = spark.createDataFrame([("x = 1\n",), ("x = 1\n# note\n\n",), ("x = 2\n",)], "t string").select(generations.body_hash(F.col("t")).alias("h")).collect()
    assert text[0].h == text[1].h != text[2].h
    schema = "path string, content_hash string, body string, structure string"
    old = spark.createDataFrame([("a", "1", "1", "1"), ("b", "1", "1", "1"), ("c", "1", "1", "1"), ("d", "1", "1", "1"), ("e", "1", "1", "1")], schema)
    new = spark.createDataFrame([("a", "1", "1", "1"), ("b", "2", "1", "1"), ("c", "2", "2", "1"), ("d", "2", "2", "2"), ("f", "1", "1", "1")], schema)
    assert {r.path: r.change for r in generations.change_kind(new, old).collect()} == {"a": "same", "b": "tail", "c": "structure", "d": "changed", "e": "gone", "f": "new"}


def test_boundary_lines_need_evidence(spark):
    schema = "file string, line_start int, line_end int, kind string, symbol string, excerpt string, caller string, callee string"
    wide = spark.createDataFrame([("f", 1, 9, "pattern", "p", "def outer(): go()", None, None), ("g", 1, 200, "pattern", "p", "def g(): pass", None, None), ("h", 5, 6, "pattern", "p", None, None, None)], schema)
    near = spark.createDataFrame([("f", 1, 1, "caller", "outer", None, "outer", "go"), ("g", 200, 200, "caller", "other", None, "other", "go"), ("g", 300, 300, "caller", "g", None, "g", "go"), ("h", 5, 5, "caller", "x", None, "x", "y")], schema)
    assert sorted(r.file for r in conjunction.within(wide, near).collect()) == ["f", "h"]
    assert [r.file for r in conjunction.within(wide, near, True).collect()] == ["g"]
    inner = spark.createDataFrame([("g", 100, 100, "caller", "other", None, "other", "go")], schema)
    assert [r.file for r in conjunction.within(wide, inner).collect()] == ["g"]


def test_finish(spark):
    schema = "kind string, file string, line_start int, line_end int, symbol string, score double, excerpt string"
    hits = spark.createDataFrame([("asgrep", "a", i, i, None, 1.0 - i / 100, "retry the window") for i in range(1, 7)] + [("asgrep", "b", 1, 1, None, 9.0, "retry"), ("embed", "a", 1, 1, None, 0.5, None), ("def", "c", 1, 2, "retry_window", 0.1, None)], schema)
    out = search.finish(hits, q.parse("retry window"), search.Options(limit=4)).orderBy("position").collect()
    assert [(r.file, r.line_start) for r in out] == [("a", 1), ("a", 2), ("a", 3), ("c", 1)]
    assert out[0].contributors == ["asgrep", "embed"] and out[0].signal == "exact" and out[0].coverage == 2
    only = search.finish(hits, q.parse("retry"), search.Options(glob="b")).collect()
    assert [(r.file, r.position) for r in only] == [("b", 1)]
    page = spark.createDataFrame([(i, f"f{i}") for i in range(1, 5)], "position int, file string")
    scores = spark.createDataFrame([(2, 5.0), (3, 7.0), (1, float("nan")), (4, 9.0), (4, 9.0)], "position int, rerank double")
    assert [r.file for r in search.reranked(page, scores, 3).orderBy("position").collect()] == ["f3", "f2", "f1", "f4"]
    assert search.filter_hits(hits, ["def", "asgrep"], "c", 0.05, 5, ["file"]).collect()[0].file == "c"
    assert not search.use_ann(1999, None) and search.use_ann(2000, None) and not search.use_ann(9999, "go")


def test_numbered_groups_of_any_size(spark):
    df = spark.createDataFrame([(g, i) for g in (1, 2, None) for i in range(40 if g == 1 else 5)], "g int, i int")
    a, b = (sorted(tuple(r) for r in numbered(df, ["g"], ["i"], "n", k).na.fill(-1).collect()) for k in (10, 1000))
    assert a == b and max(r[2] for r in a) == 40


GO = "package x\n\n// Adds one.\n// Twice.\nfunc add(a int) int {\n\treturn twice(a)\n}\n\ntype S struct {\n\tn int\n}\n\nfunc twice(a int) int {\n\treturn a\n}\n"


def test_built_chunks(spark):
    src = spark.createDataFrame([("a.go", "go", GO), ("b.py", "python", "# Not near.\n\nclass A:\n    # Says hi.\n    def f(self):\n        return g(1)\n")], "path string, language string, content string")
    lines = src.select("path", "language", F.posexplode(F.split("content", "\n")).alias("p", "content")).withColumn("line_no", F.col("p") + 1)
    got = {r.symbol_name: r for r in structure.build_chunks(extract.extract(src), lines).collect()}
    assert set(got) == {"add", "twice", "f"}
    assert got["add"].doc == "Adds one.\nTwice." and got["add"].callees == ["twice"] and got["twice"].callers == ["add"] and got["add"].excerpt == "twice(a)"
    assert got["f"].scope == "A" and got["f"].doc == "Says hi." and got["twice"].doc is None


def test_structural_index(spark):
    src = spark.createDataFrame([("a.go", "go", GO), ("b.rs", "rust", "pub struct S { a: u8 }\nenum E { A }\ntrait T { fn go(&self); }\nfn add(x: u8) { add(x); }\n")], "path string, language string, content string")
    all_ = extract.extract(src)
    kinds = {(r.name, r.kind) for r in all_.filter("fact = 'symbol'").collect()}
    assert {("E", "enum"), ("T", "interface"), ("S", "class"), ("add", "function")} <= kinds
    nodes = structure.nodes(all_)
    held = {r.signature for r in nodes.collect()}
    assert {"decl:struct:S", "struct S", "decl:enum:E", "decl:interface:T", "fn add", "call:twice", "call-name:add", "kind:function"} <= held
    assert {(r.file, r.score) for r in structure.lookup(nodes, "fn add").collect()} == {("a.go", 7.0), ("b.rs", 7.0)}
    assert structure.lookup(nodes, "fn $N($$$) { $$$ }") is None
    assert {r.file for r in structure.find(nodes, src, "fn $N($$$)").collect()} == {"a.go", "b.rs"}
    one = structure.find(nodes, src, "twice($$$)").collect()
    assert len(one) == len({(r.file, r.line_start, r.line_end) for r in one}) == 1
    assert all(r.score == 0.85 * 7 for r in structure.by_terms(nodes, ["add", "of"]).collect())


def test_rewriting(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = render(a, 1)\ny = 2\n")
    src = spark.createDataFrame([("a.py", "python", "x = render(a, 1)\ny = 2\n")], "path string, language string, content string")
    plan = extract.codemod(src, "render($$$ARGS)", "draw($$$ARGS, $$)")
    assert plan.first().rewritten == "x = draw(a, 1, $)\ny = 2\n"
    assert extract.match_pattern(src, "$F($$$A)").first().captures["A"] == "a, 1"
    assert extract.apply(spark, plan, str(tmp_path)) == 1 and (tmp_path / "a.py").read_text() == plan.first().rewritten
    with pytest.raises(ValueError):
        extract.apply(spark, plan, str(tmp_path))


def test_graph_with_imports_and_hops(spark):
    calls = spark.createDataFrame([("p1", "a", "b"), ("p1", "b", "c")], "path string, caller string, callee string")
    syms = spark.createDataFrame([("p1", "a", 0), ("p1", "b", 1), ("p2", "c", 2), ("p3", "c", 3)], "path string, name string, byte_start long")
    imports = spark.createDataFrame([("p9", "p1")], "path string, target string")
    seeds = spark.createDataFrame([("p9", 1.0)], "file string, score double")
    assert {r.file for r in graph.chain(seeds, graph.file_edges(calls, syms, imports=imports)).collect()} == {"p9", "p1", "p2", "p3"}
    got = graph.hops(graph.call_path(calls, syms, "a", "c"), syms).orderBy("hop").collect()
    assert [(r.callee, r.resolution, len(r.candidates)) for r in got] == [("b", "repository_unique", 1), ("c", "ambiguous", 2)]
    tiers = spark.createDataFrame([(t,) for t in symbols.PRECISION], "t string").filter(symbols.precise(F.col("t")))
    assert tiers.count() == 3


def test_module_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/lib/index.ts", "pkg/__init__.py", "pkg/m.py", "src/net/mod.rs", "inc/x.h")], "path string")
    edges = spark.createDataFrame([("src/b.ts", "typescript", 1, "./a"), ("src/b.ts", "typescript", 2, "./lib"), ("pkg/k.py", "python", 1, ".m"), ("z.py", "python", 1, "pkg"), ("src/main.rs", "rust", 1, "crate::net"), ("inc/y.c", "c", 1, "x.h"), ("q.py", "python", 1, "unknown")], "path string, language string, line_no int, module string")
    got = {(r.path, r.line_no): r.target for r in chunks.resolve_imports(edges, files).collect()}
    assert got == {("src/b.ts", 1): "src/a.ts", ("src/b.ts", 2): "src/lib/index.ts", ("pkg/k.py", 1): "pkg/m.py", ("z.py", 1): "pkg/__init__.py", ("src/main.rs", 1): "src/net/mod.rs", ("inc/y.c", 1): "inc/x.h"}


def test_functions_in_sql(spark):
    assert "extract_facts" in udfs.register(spark)
    r = spark.sql("SELECT ascii_lower('ÄB') AS a, rrf(0) AS b, score_symbol('parse', 'Parse') AS c, kind_weight('class') AS d, porter('running') AS e, size(embed_hashed('a b')) AS f, edit_distance('ab', 'b') AS g, module_candidates('a/b.py', '.c', 'python') AS h").first()
    assert (r.a, round(r.b, 6), r.c, r.d, r.e, r.f, r.g, r.h[0]) == ("Äb", 0.016393, 5.0, 0.65, "run", 256, 1, "a/c.py")
    assert {x.name for x in spark.sql("SELECT name FROM extract_facts('a.py', 'python', 'def f(): g()') WHERE fact = 'symbol'").collect()} == {"f"}
    assert spark.sql("SELECT captures['NAME'] AS n FROM match_pattern('a.py', 'python', 'def f(): g()', 'def $NAME($$$)')").first().n == "f"


def test_tools(spark, root, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    ledger = str(tmp_path / "ledger.ndjson")
    s = tools.Session(spark, root, ledger)
    hits = s.call("definitions", name="parse", limit=2)
    assert len(hits) <= 2 and s.call("definitions", name="parse", limit=2) is hits
    file = index.open_index(spark, root).lines.orderBy("path").first().path
    first = s.call("code_read", file=file, start=1, end=2)
    s.responses.held.clear()
    assert first != "~" and s.call("code_read", file=file, start=1, end=2) == "~"
    out = s.batch([{"id": i, "tool": t, "args": a} for i, (t, a) in enumerate([("index_status", {}), ("callers", {"name": "render"}), ("definitions", {"nam": "x"}), ("keyword_serch", {"query": "x"})])])
    assert [o["ok"] for o in out] == [True, True, False, False] and "keyword_search" in out[3]["error"]
    assert len(s.batch([{"tool": "index_status"}] * 4)) == 4
    notes = [json.loads(x) for x in (tmp_path / "ledger.ndjson").read_text().splitlines()]
    assert notes and set(notes[0]) == {"ts", "query", "hits", "bytes"}
    tools.note("/etc/x", "q", 1, 1)
    assert tools.main(["capabilities"]) == 0 and tools.main(["status", root]) == 0 and tools.main(["definitions", root, "nme=x"]) == 2
    assert len(tools.CATALOG) == 12 and tools.nearest("calers", list(tools.CATALOG)) == "callers"


def test_shown_paths_and_positions():
    roots, short = planner.fold_roots(paths := [*[f"a/long/folder/{c}.py" for c in "xyzw"], "b.py"])
    assert [next((v + p[len(k) :] for k, v in roots.items() if p.startswith(k)), p) for p in short] == paths and roots
    text = "a\n𝒳 foo_bar\n"
    assert text[planner.utf16(text, 1, 3)] == "f" and planner.identifier_at(text, planner.utf16(text, 1, 5)) == "foo_bar" and planner.cut("äb", 1) == ""


def test_gold_and_measures(spark, tmp_path):
    path = tmp_path / "gold.json"
    path.write_text(json.dumps({"corpus": "c", "queries": [{"name": "n", "query": "q", "k": 2, "relevant": [{"file": "a", "symbol": "s"}, {"file": "a"}]}]}))
    judged, edges = corpus.gold(spark, str(path))
    assert judged.count() == 2 and edges.count() == 0
    ranked = spark.createDataFrame([("n", 1, "a", "s"), ("n", 2, "a", "s"), ("n", 3, "b", None)], "name string, position int, file string, symbol string")
    assert sorted((r.gold_id, r.position) for r in evaluate.greedy(ranked, judged, ["name"]).collect()) == [(0, 1), (1, 2)]
    path.write_text('{"corpus": "c"}')
    with pytest.raises(ValueError):
        corpus.gold(spark, str(path))
    runs = spark.createDataFrame([("x", v) for v in (1.0, 2.0, 4.0)], "query string, seconds double")
    assert round(evaluate.timings(runs).first().geomean, 6) == 2.0
    assert evaluate.churn({"def": 1.0, "embed": 1.0}, [{"def": 0}, {"embed": 0}], "embed") == 2
    (tmp_path / "t" / "sub").mkdir(parents=True)
    (tmp_path / "t" / ".gitignore").write_text("skip.py\n")
    (tmp_path / "t" / "sub" / ".gitignore").write_text("*.go\n")
    for name in ("skip.py", "keep.py", "sub/a.go", "sub/b.py"):
        (tmp_path / "t" / name).write_text("x = 1\n")
    assert sorted(r.path for r in corpus.tree(spark, str(tmp_path / "t")).collect()) == ["keep.py", "sub/b.py"]


def test_vectors_of_the_index(spark, tmp_path):
    texts = [(f"f{i}.py", i, i + 1, f"name_{i}", f"walks the {w} list and counts {w} entries {i}") for i, w in enumerate(["red", "green", "token", "cache", "parser"] * 12)]
    df = spark.createDataFrame(texts, "path string, line_start int, line_end int, symbol_name string, text string")
    where = str(tmp_path / "v")
    index.build_vectors(spark, df, where)
    got = [r.path for r in index.semantic(spark, where, texts[7][4], 5).collect()]
    assert got[0] == "f7.py" and len(got) == 5
    known = vectors.fingerprint(generations.read(spark, where, "vectors"), "id", "vector")
    assert generations.pointer(spark, where)["identity"].endswith(known)
    chunks_ = spark.createDataFrame([("a", 1, "x")], "path string, line_start int, text string")
    lines = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("b", 1, "z")], "path string, line_start int, text string")
    assert sorted((r.path, r.line_start) for r in vectors.with_lines(chunks_, lines, 1).collect()) == [("a", 1), ("b", 1)]


def test_recall_of_the_inverted_file(spark):
    """Recall at 10 of 0.99 or more with at most 95 % of the rows read."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2048, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    c = vectors.ivf_fit(x, len(x))
    cells = vectors.ivf_assign(df, "id", "v", c).cache()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = 0
    for i in range(0, 2048, 256):
        want = set(np.argsort(-(u @ u[i]))[:10].tolist())
        found += len(want & {r.id for r in vectors.ivf_search(cells, x[i].tolist(), "id", "v", c, 10).collect()})
    assert found >= 0.99 * 80


def test_pattern_filter_changes_no_match(spark):
    src = spark.createDataFrame([("a.py", "python", "def parse(a):\n    return parse_all(a)\n"), ("b.py", "python", "x = 1\n"), ("c.go", "go", GO)], "path string, language string, content string")
    for text in ("parse_all($$$)", "def parse($$$)", "twice($A)", "add"):
        want = {(p, a) for p, lang, t in [tuple(r) for r in src.collect()] for a, _, _ in extract.matches(t, lang, q.pattern(text))}
        got = extract.match_pattern(src, text).collect()
        assert len(got) == len(want) and {r.path for r in got} == {p for p, _ in want}
