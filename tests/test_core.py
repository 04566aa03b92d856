"""Driver-side rules and the core operators on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from siftspark.functions.prefix import prefix_sums, salted_rank
from siftspark.operators import conjunction, extract, fusion, graph, lexical, lexicon, symbols, text, vectors
from siftspark.plans import catalog, hybrid, planner
from siftspark.plans import query as q
from siftspark.sources import corpus
from siftspark.streaming import generations


def test_grammar():
    assert q.parse("defs: Foo").mode == "defs" and q.parse("defs: Foo").target == "Foo"
    assert q.parse("lang:go x").mode == "hybrid" and q.parse("(a)").mode == "hybrid"
    assert q.parse('"a b"').mode == "literal"
    assert q.scoring_terms("how does fooBar_baz work") == ("bar", "baz", "foo", "foobar", "foobar_baz", "work")
    assert q.scoring_terms("the of") == ("of", "the")
    c = q.parse_conjunction("pattern:fn $N($$$) AND NOT callers:x")
    assert c.negated and c.scope == "span" and q.parse_conjunction("a AND b") is None
    assert [q.classify(x) for x in ('"x"', "a => b", "fooBar", "how it works")] == ["literal", "structural", "symbol", "conceptual"]
    with pytest.raises(q.QueryError):
        q.glob_regex("")
    assert q.required_literal(r"abc+def") == "abc" and q.required_literal("a|b") is None


def test_patterns():
    js = "class A {\n  foo(a, b) {\n    bar.baz(a, 1);\n    // qux(1)\n  }\n}\nfunction top() {}\n"
    found = extract.facts(js, "javascript")
    assert ("call", "baz", "foo") in {(f[0], f[2], f[3]) for f in found}
    assert not any(f[2] == "qux" for f in found)
    assert [m[2]["MATCH"] for m in extract.matches(js, "javascript", q.pattern("bar.$M($$$)"))] == ["bar.baz(a, 1)"]
    assert len(extract.matches(js, "javascript", q.pattern("function $N() {}"))) == 1
    py = "import os\ndef f(a):\n    return g(a)\n"
    assert {(f[0], f[2]) for f in extract.facts(py, "python") if f[0] in ("import", "call", "symbol")} == {("import", "os"), ("symbol", "f"), ("call", "g")}
    for lang, src in {"rust": "use a::b;\nfn f(x: u8) { g(x); }", "go": "import \"x\"\nfunc f(a int) { g(a) }", "java": "import a.b;\nclass A { int f(int a) { g(a); } }", "ruby": "require 'x'\ndef f(a)\n  g(a)\nend\n", "php": "<?php\nuse A\\B;\nfunction f($a) { g($a); }"}.items():
        kinds = {(f[0], f[2]) for f in extract.facts(src, lang)}
        assert ("symbol", "f") in kinds and ("call", "g") in kinds and any(k == "import" for k, _ in kinds), lang


def test_codemod(spark):
    src = spark.createDataFrame([("a.py", "python", "x = render(1)\n"), ("b.py", "python", "y = 1\n"), ("c", None, None)], "path string, language string, content string")
    assert [tuple(r) for r in extract.codemod(src, "render($$$)", "draw_$MATCH").drop("original").collect()] == [("a.py", 1, "x = draw_render(1)\n", None)]


def test_lines_and_words(spark):
    rows = text.split_lines(spark.createDataFrame([(1, "a\r\nb\n"), (2, ""), (3, None)], "id long, text string"))
    assert sorted((r.id, r.line_no, r.content) for r in rows.collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (2, 1, ""), (3, 1, "")]
    w = spark.createDataFrame([("a_token",), ("(token)",), ("tokens",)], "content string")
    assert [r[0] for r in w.filter(text.word(F.col("content"), "token")).collect()] == ["(token)"]


def test_prefix_sums_span_tasks(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"))
    out = prefix_sums(rows, ["g"], ["o"], {"n": F.lit(1)}).toPandas()
    assert all((out.sort_values(["g", "o"]).groupby("g").cumcount() == out.sort_values(["g", "o"])["n"]))
    ranked = salted_rank(rows, "g", "o", 100, {0: 2500, 1: 2500}).toPandas()
    assert all(sorted(v) == list(range(2500)) for _, v in ranked.groupby("g")["rank"])


def test_fusion(spark):
    rows = [(1, "f", 1, 2, "s", "def", 3.0, "structural", None, "py", "symbol"), (1, "f", 1, 2, "s", "embed", 0.5, "semantic", None, "py", "symbol"), (1, "g", 1, 2, None, "embed", float("nan"), "semantic", None, None, "symbol")]
    hits = spark.createDataFrame(rows, "q long, file string, line_start int, line_end int, symbol string, kind string, score double, signal string, contributors array<string>, language string, intent string")
    fused = {r.file: r for r in fusion.weighted_rrf(hits, ["q"]).collect()}
    assert set(fused) == {"f"} and fused["f"].score == pytest.approx(2.8 / 61, abs=1e-8) and fused["f"].kind == "def"
    d = {r.file: r for r in fusion.dedup(hits, ["q"]).collect()}
    assert d["f"].contributors == ["def", "embed"] and d["f"].signal == "structural" and d["g"].score is None
    assert fusion.critic(fusion.weighted_rrf(hits, ["q"])).first().critic == "semantic_structural"


def test_conjunction(spark):
    schema = "file string, line_start int, line_end int, kind string, contributors array<string>"
    a = spark.createDataFrame([("f", 1, 9, "def", ["def"]), ("f", 5, 6, "def", ["def"]), ("g", 1, 2, "def", ["def"])], schema)
    b = spark.createDataFrame([("f", 5, 5, "asgrep", ["asgrep"])], schema)
    assert conjunction.and_file(a, b).count() == 2 and conjunction.and_file(a, b, True).count() == 1 and conjunction.and_span(a, b, True).count() == 1
    assert {(r.line_start, tuple(r.contributors)) for r in conjunction.merge_evidence(a, b).filter("file = 'f'").collect()} == {(1, ("asgrep", "def")), (5, ("def",))}


def test_graph(spark):
    calls = spark.createDataFrame([("p1", "a", "b"), ("p1", "b", "c"), ("p2", "c", "D"), ("p2", "x", "d")], "path string, caller string, callee string")
    syms = spark.createDataFrame([("p1", "a", 0), ("p1", "b", 1), ("p2", "c", 2), ("p3", "d", 3)], "path string, name string, byte_start long")
    assert [tuple(r) for r in graph.call_path(calls, syms, "A", "d").collect()] == [(1, "a", "b"), (2, "b", "c"), (3, "c", "d")]
    assert graph.call_path(calls, syms, "d", "a").count() == 0
    seeds = spark.createDataFrame([("p1", 1.0)], "file string, score double")
    assert {tuple(r) for r in graph.chain(seeds, graph.file_edges(calls, syms)).collect()} == {("p1", 1.0, 0), ("p2", 0.5, 1), ("p3", 0.25, 2)}


def test_scip_and_ignore(spark):
    doc = json.dumps({"documents": [{"relativePath": "./a.rs", "occurrences": [{"symbol": "x `f`().", "symbolRoles": 1, "range": [4, 0, 1]}]}]})
    rows, reason = corpus.scip(spark, doc)
    assert [tuple(r) for r in rows.collect()] == [("a.rs", 5, "f", True)] and reason is None
    assert corpus.scip(spark, "{")[1] == "malformed" and corpus.scip(spark, None)[1] == "missing"
    hide = corpus.Ignore({"": "build/\n*.log\n!keep.log\n", "sub": "/x.py"})
    assert hide("build/a.py") and hide("a/b.log") and not hide("keep.log") and hide("sub/x.py") and not hide("x.py")


def test_tree(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / ".hidden.py").write_text("x")
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "b.go").write_text("package x\n")
    rows = corpus.tree(spark, str(tmp_path), {"": "skip/"}).collect()
    assert [(r.path, r.language) for r in rows] == [("a.py", "python")]


def test_generations(spark, tmp_path):
    root = str(tmp_path / "g")
    one = spark.createDataFrame([("a", "h1"), ("d/x", "h2")], "path string, content_hash string")
    assert generations.publish(spark, root, {"files": one}) == 1
    new = spark.createDataFrame([("a", "h3")], "path string, content_hash string")
    gone = spark.createDataFrame([("d",)], "path string")
    generations.publish(spark, root, {"files": generations.upsert(generations.read(spark, root, "files"), new, gone)})
    assert [tuple(r) for r in generations.read(spark, root, "files").collect()] == [("a", "h3")]
    assert generations.read(spark, root, "files", 1).count() == 2


def test_stream(spark, tmp_path):
    events = tmp_path / "in"
    events.mkdir()
    rows = [{"path": "a", "content": "1", "deleted": False, "at": 1}, {"path": "a", "content": "2", "deleted": False, "at": 2}, {"path": "b", "content": "x", "deleted": True, "at": 3}]
    (events / "1.json").write_text("\n".join(json.dumps(r) for r in rows))
    src = spark.readStream.schema("path string, content string, deleted boolean, at long").json(str(events))
    run = generations.stream(src, str(tmp_path / "g"), lambda d: d.select("path", "content"), str(tmp_path / "c"))
    run.processAllAvailable()
    run.stop()
    assert [tuple(r) for r in generations.read(spark, str(tmp_path / "g"), "files").collect()] == [("a", "2")]


def test_hybrid(spark):
    lines = spark.createDataFrame([("a.py", "python", 1, "def refresh_token():"), ("b.py", "python", 1, "nothing")], "path string, language string, line_no int, content string")
    syms = spark.createDataFrame([("a.py", "python", "refresh_token", "function", 1, 2, 0, 9)], "path string, language string, name string, kind string, line_start int, line_end int, byte_start long, byte_end long")
    calls = spark.createDataFrame([("a.py", "python", "main", "refresh_token", 5)], "path string, language string, caller string, callee string, line_no int")
    top = hybrid.search("refresh token", lines, syms, calls).first()
    assert (top.file, top.line_start, top.kind, top.position) == ("a.py", 1, "def", 1)


def test_hybrid_search_runs_the_semantic_stage(spark):
    found = catalog.hybrid_search(spark, "/root/testdata/sf0.001").collect()
    assert any("embed" in r.contributors for r in found)


def test_text_units():
    assert [lexical.stem(w) for w in ("caresses", "running", "relational")] == ["caress", "run", "relat"]
    v = vectors.embed_text("store the session")
    assert len(v) == 256 and abs(sum(x * x for x in v) - 1) < 1e-4 and vectors.embed_text("store the session") == v
    assert "oauth" in vectors.expand_concepts("login page")
    assert planner.diagnose(0, False, 0) == "empty_index"
    assert planner.follow_ups([{"contributors": ["asgrep"], "score": 1.0, "margin": 0.0}], "foo") == ["defs:foo", "callers:foo", "literal:foo"]
    hits = [{"file": "f", "line_start": 1, "kind": "def", "excerpt": "x" * 500}]
    assert len(json.dumps(planner.budgeted(hits, 80)[0])) <= 80
    assert planner.run_plan([{"id": "a", "tool": "t", "args": {"x": 2}}, {"id": "b", "tool": "t", "args": {"x": "$a.v"}}], {"t": lambda x: {"v": x + 1}}, "$b.v") == 4
    for form in ("native", "lines", "agent", "capsule", "compact", "github", "gitlab"):
        assert planner.render(hits, form)


def test_lexicon_and_resolution(spark):
    chunks = spark.createDataFrame([(i, "refreshToken", "renew the session") for i in range(3)] + [(9, "other", "thing here")], "chunk_id long, symbol_name string, doc string")
    assert {"session"} <= {r.related for r in lexicon.ppmi(lexicon.observations(chunks)).filter("term = 'token'").collect()}
    calls = spark.createDataFrame([("p", "a", "F"), ("p", "a", "g"), ("p", "a", "h"), ("q", "a", "g")], "path string, caller string, callee string")
    syms = spark.createDataFrame([("p", "f"), ("q", "g"), ("r", "g")], "path string, name string")
    assert {(r.path, r.callee): r.resolution for r in symbols.resolution(calls, syms).collect()} == {("p", "F"): "file_local_unique", ("p", "g"): "ambiguous", ("p", "h"): "name_only", ("q", "g"): "file_local_unique"}


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "weighted_rrf" in e.queries()


def test_chunks_and_modules(spark):
    from siftspark.operators import chunks, evaluate

    assert chunks.candidates("a/b/c.py", "..x", "python")[0] == "a/x.py" and "a/x.ts" in chunks.candidates("a/b.ts", "./x", "typescript")
    edges = spark.createDataFrame([("a/b.ts", "typescript", 1, "./x"), ("a/b.ts", "typescript", 2, "react"), ("m.c", "c", 1, "h.h")], "path string, language string, line_no int, module string")
    files = spark.createDataFrame([("a/x.tsx",), ("a/x/index.ts",), ("h.h",)], "path string")
    assert sorted(tuple(r) for r in chunks.resolve_imports(edges, files).collect()) == [("a/b.ts", 1, "./x", "a/x.tsx"), ("m.c", 1, "h.h", "h.h")]
    c = spark.createDataFrame([(1, "t/tests/x.py", "function", "f", "def f()", ["b", "a"], [], "", "C")], "chunk_id long, path string, kind string, symbol_name string, excerpt string, callers array<string>, callees array<string>, doc string, scope string")
    assert c.select(chunks.rendered()).first()[0] == "excerpt: def f()\nsymbol: f\nkind: function\nscope: C\ncalled_by: a b"
    assert tuple(chunks.fields(c).first()) == (1, "f", None, "def f()", "a b ", "def f()")
    judged = [({"def": 0}, {"embed": 0})] * 3
    learnt = evaluate.learn_weights({"def": 1.0, "embed": 1.0}, judged)
    assert learnt["def"] > learnt["embed"] and evaluate.pairwise_loss(learnt, judged) < evaluate.pairwise_loss({"def": 1.0, "embed": 1.0}, judged)


def test_symbol_texts_send_no_table_to_the_driver(spark, tmp_path):
    """Definitions spread over their lines are not broadcast, however small their table is; the texts are those of the SQL."""
    spark.range(1, 5).selectExpr("id AS file_id", "'r' AS repo", "IF(id > 2, './b', concat('a', id)) AS path", "'py' AS language", "'h' AS content_hash", "id AS indexed_at").coalesce(1).write.parquet(f"{tmp_path}/files.parquet")
    lines = spark.range(1, 201).selectExpr("1L AS file_id", "CAST(id AS INT) AS line_no", "IF(id % 70 = 0, NULL, concat('l', id)) AS content")
    odd = spark.createDataFrame([(2, 1, "x" * 1600 + "y"), (2, 1, "x" * 1600 + "z"), (2, 64, "é"), (3, 5, "c"), (4, 6, "d"), (9, 1, "no file")], "file_id long, line_no int, content string")
    lines.unionByName(lines).unionByName(odd).coalesce(1).write.parquet(f"{tmp_path}/source_lines.parquet")
    # over blocks, twice, at a block's edge, equal starts of long lines, two files of one path, one id twice, a null line, backwards, no end, no line, no file
    spans = [(1, 1, 60, 130), (1, 1, 60, 130), (2, 1, 63, 64), (3, 2, 1, 64), (4, 3, 1, 9), (5, 1, 1, 2), (5, 2, 64, 64), (6, 1, 70, 70), (7, 1, 9, 8), (8, 1, 9, None), (9, 1, 300, 900), (10, 8, 1, 2)]
    spark.createDataFrame(spans, "symbol_id long, file_id long, line_start int, line_end int").coalesce(1).write.parquet(f"{tmp_path}/symbols.parquet")
    got = catalog.symbol_texts(spark, str(tmp_path))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    long = " ".join(["x" * 1600] * 2)
    want = [(1, " ".join(f"l{n}" for n in range(60, 131) if n != 70)), (2, "l63 l64"), (3, f"{long} é"), (4, "c d"), (5, "l1 l2 é"), (6, None)]
    assert sorted(tuple(r) for r in got.collect()) == want
