"""The queries of the core, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.operators import chunks, conjunction, evaluate, extract, fusion, graph, lexical, lexicon, structure, symbols, text, vectors
from siftspark.plans import hybrid, index, search
from siftspark.plans.query import parse, parse_conjunction
from siftspark.sources import facts
from siftspark.sources.tables import table
from siftspark.streaming import generations

QUERIES: dict = {}
SQL: dict[str, str] = {}
VIEWS = "WITH " + facts.SQL + "\n"


def query(sql: str | None = None, views: bool = True):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (VIEWS + sql) if views else sql
        return f

    return add


# --- lines and exact channels -------------------------------------------------------------


@query("SELECT doc_id, CAST(n AS INT) AS line_no, regexp_replace(line, '\\r$', '') AS content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)", views=False)
def lines_explode(spark: SparkSession, d: str) -> DataFrame:
    return text.split_lines(table(spark, d, "documents").select("doc_id", "text"))


@query("SELECT path AS file, line_no AS line_start, content FROM l WHERE contains(content, 'retry')")
def literal_cs(spark: SparkSession, d: str) -> DataFrame:
    return facts.lines(spark, d).filter(text.literal(F.col("content"), "retry")).select(F.col("path").alias("file"), F.col("line_no").alias("line_start"), "content")


@query("SELECT path AS file, line_no AS line_start, content FROM l WHERE contains(lower(content), 'todo')")
def literal_ci(spark: SparkSession, d: str) -> DataFrame:
    return facts.lines(spark, d).filter(text.literal(F.col("content"), "TODO", ignore_case=True)).select(F.col("path").alias("file"), F.col("line_no").alias("line_start"), "content")


@query("SELECT path AS file, line_no AS line_start, content FROM l WHERE regexp_matches(content, '(^|[^\\p{L}\\p{N}_])token($|[^\\p{L}\\p{N}_])')")
def word_boundary(spark: SparkSession, d: str) -> DataFrame:
    return facts.lines(spark, d).filter(text.word(F.col("content"), "token")).select(F.col("path").alias("file"), F.col("line_no").alias("line_start"), "content")


@query("SELECT path AS file, line_no AS line_start, content FROM l WHERE regexp_matches(content, 'return [0-9]+')")
def regex_lines(spark: SparkSession, d: str) -> DataFrame:
    return facts.lines(spark, d).filter(text.regex(F.col("content"), "return [0-9]+")).select(F.col("path").alias("file"), F.col("line_no").alias("line_start"), "content")


@query("SELECT path AS file, line_no AS line_start, 1.0::DOUBLE / (1.0::DOUBLE + 0.01::DOUBLE * (row_number() OVER (ORDER BY path, line_no) - 1)) AS score FROM l WHERE contains(content, 'import') ORDER BY path, line_no LIMIT 200")
def rank_decay(spark: SparkSession, d: str) -> DataFrame:
    return text.scan(facts.lines(spark, d), text.literal(F.col("content"), "import"), total=0).select("file", "line_start", "score")


@query("SELECT file, line_start, late FROM (SELECT path AS file, line_no AS line_start, CAST(row_number() OVER (PARTITION BY path ORDER BY line_no) > 3 AS INT) AS late FROM l WHERE regexp_matches(content, 'import|use |require')) ORDER BY late, file, line_start LIMIT 100")
def regex_preferred3(spark: SparkSession, d: str) -> DataFrame:
    rows = facts.lines(spark, d).filter(text.regex(F.col("content"), "import|use |require")).select(F.col("path").alias("file"), F.col("line_no").alias("line_start"))
    return text.per_file_first(rows).select("file", "line_start", "late")


@query("SELECT path, language FROM f WHERE regexp_matches(path, '^(.*/)?.*/lib/.*\\.py$')")
def file_glob(spark: SparkSession, d: str) -> DataFrame:
    return text.in_files(facts.files(spark, d), "**/*/lib/*.py").select("path", "language")


@query("SELECT path, language FROM f WHERE language = 'go'")
def lang_filter(spark: SparkSession, d: str) -> DataFrame:
    return text.in_language(facts.files(spark, d), "golang").select("path", "language")


@query("SELECT path AS file, count(*) AS n FROM l WHERE contains(content, 'class ') GROUP BY path")
def count_only(spark: SparkSession, d: str) -> DataFrame:
    rows = facts.lines(spark, d).filter(text.literal(F.col("content"), "class ")).select(F.col("path").alias("file"))
    return text.count_only(rows)


@query("SELECT a.path AS file, a.line_no AS line_start, string_agg(b.content, chr(10) ORDER BY b.line_no) AS excerpt FROM (SELECT * FROM l WHERE contains(content, 'password') ) a JOIN l b ON b.path = a.path AND b.line_no BETWEEN a.line_no - 2 AND a.line_no + 2 GROUP BY a.path, a.line_no")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    own = facts.lines(spark, d)
    hit = own.filter(text.literal(F.col("content"), "password")).select(F.col("path").alias("file"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.col("content").alias("excerpt"))
    return text.context(hit, own).select("file", "line_start", "excerpt")


@query("SELECT path, count(*) AS n_lines, sha256(string_agg(content, chr(10) ORDER BY line_no)) AS content_hash FROM l GROUP BY path")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = facts.lines(spark, d).groupBy("path").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "content"))), lambda x: x.content), "\n").alias("t"))
    return rows.select("path", "n_lines", F.sha2("t", 256).alias("content_hash"))


# --- lexical ------------------------------------------------------------------------------


@query("SELECT path, line_no, term, count(*) AS tf FROM (SELECT path, line_no, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+')) AS term FROM l) GROUP BY path, line_no, term")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(facts.lines(spark, d)).select("path", "line_no", "term", "tf")


_BM25 = """, t AS (SELECT path, line_no, regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+') AS t FROM l),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t),
m AS (SELECT path, line_no, dl, term, count(*) AS tf FROM (SELECT path, line_no, len(t) AS dl, unnest(t) AS term FROM t) WHERE term IN ('retry', 'window', 'kept') GROUP BY ALL),
q AS (SELECT term, count(*) AS df FROM m GROUP BY term),
b AS (SELECT path, line_no, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score FROM m JOIN q USING (term), st GROUP BY path, line_no)
"""


@query(_BM25 + "SELECT path, line_no, score FROM b ORDER BY score DESC, path, line_no LIMIT 100")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(facts.lines(spark, d), ["retry", "window", "kept"])


@query(_BM25 + "SELECT path, line_no, round(200.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, path, line_no)), 6) AS score FROM b ORDER BY score DESC, path, line_no LIMIT 100")
def lexical_rrf(spark: SparkSession, d: str) -> DataFrame:
    best = lexical.ranked(lexical.bm25(facts.lines(spark, d), ["retry", "window", "kept"]))
    return best.select("path", "line_no", F.round(lexical.rrf(F.col("rank")) * lexical.SCALE, 6).alias("score"))


def _ranked_sql(name: str, word: str, terms: str) -> str:
    return f"""{name}t AS (SELECT path, line_no, regexp_extract_all(lower(content), '{word}') AS t FROM l),
{name}s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {name}t),
{name}m AS (SELECT path, line_no, dl, term, count(*) AS tf FROM (SELECT path, line_no, len(t) AS dl, unnest(t) AS term FROM {name}t) WHERE term IN ({terms}) GROUP BY ALL),
{name}q AS (SELECT term, count(*) AS df FROM {name}m GROUP BY term),
{name}b AS (SELECT path, line_no, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score FROM {name}m JOIN {name}q USING (term), {name}s GROUP BY path, line_no),
{name}r AS (SELECT path, line_no, row_number() OVER (ORDER BY score DESC, path, line_no) AS r FROM {name}b ORDER BY score DESC, path, line_no LIMIT 100)"""


@query(", " + _ranked_sql("c", "[\\p{L}\\p{N}_]+", "'rotated', 'tries'") + ", " + _ranked_sql("p", "[\\p{L}\\p{N}]+", "'rotated', 'tries'") + " SELECT path, line_no, round(sum(1.0::DOUBLE / (60 + r)) * 200, 6) AS score FROM (SELECT * FROM cr UNION ALL SELECT * FROM pr WHERE (SELECT count(*) FROM cr) < 100) GROUP BY path, line_no ORDER BY score DESC, path, line_no LIMIT 100")
def lexical_fallback_union(spark: SparkSession, d: str) -> DataFrame:
    return lexical.lexical(facts.lines(spark, d), ["rotated", "tries"])


@query()
def porter_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = facts.documents(spark, d).select(F.explode(lexical.prose_terms(F.col("text"))).alias("term")).distinct()
    return terms.select("term", lexical.porter("term").alias("stem"))


# --- symbols ------------------------------------------------------------------------------

_DEF = "CASE WHEN lower(name) = 'parse' THEN 5.0::DOUBLE WHEN contains(lower(name), 'parse') OR contains('parse', lower(name)) THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END"


@query(f"SELECT path AS file, line_start, name AS symbol, (2 * {_DEF} + 3.0::DOUBLE) * CASE WHEN kind IN ('function', 'method') THEN 1.0::DOUBLE ELSE 0.65::DOUBLE END AS score FROM (SELECT * FROM s WHERE lower(name) = 'parse' ORDER BY CASE WHEN kind IN ('function', 'method') THEN 0 ELSE 1 END, path, byte_start LIMIT 500)")
def defs_exact(spark: SparkSession, d: str) -> DataFrame:
    return symbols.defs(facts.symbols(spark, d), "Parse", ["parse"]).select("file", "line_start", "symbol", "score")


@query("SELECT path AS file, line_no AS line_start, caller, callee FROM (SELECT * FROM e WHERE lower(callee) = 'render' ORDER BY path, line_no, caller, callee LIMIT 500)")
def callers_exact(spark: SparkSession, d: str) -> DataFrame:
    return symbols.callers(facts.calls(spark, d), "render", ["render"]).filter("hit = 'caller'").select("file", "line_start", "caller", "callee")


@query("SELECT unnest(['caller', 'graph']) AS hit, path AS file, line_no AS line_start, caller, callee, unnest([2 * 5.0::DOUBLE + 1.5, 5.0::DOUBLE]) AS score FROM (SELECT * FROM e WHERE lower(callee) = 'render' ORDER BY path, line_no, caller, callee LIMIT 500)")
def caller_graph_union(spark: SparkSession, d: str) -> DataFrame:
    return symbols.callers(facts.calls(spark, d), "render", ["render"]).select("hit", "file", "line_start", "caller", "callee", "score")


_IMPORTS = """, i0 AS (SELECT path, language, line_no, trim(content) AS t FROM l WHERE regexp_matches(content, '^\\s*(from|import|export|use|using|require|#\\s*include)\\b')),
i1 AS (SELECT *, regexp_extract(t, '^(?:import\\b.*?|export\\b.*?\\bfrom\\s*|require(?:_relative)?\\s*\\(?|#\\s*include\\s*)["''<]([^"''>]+)["''>]', 1) AS quoted, regexp_extract(t, '^(?:from|import|use|using|package)\\s+(?:static\\s+)?([A-Za-z_][\\w.:\\\\]*)', 1) AS plain FROM i0),
i AS (SELECT path, language, line_no, CASE WHEN quoted <> '' THEN quoted WHEN plain <> '' AND NOT starts_with(t, 'package') THEN CASE WHEN language = 'rust' THEN replace(plain, '::', '/') ELSE plain END END AS module FROM i1)
"""


@query(_IMPORTS + "SELECT path, line_no, module, 2.0::DOUBLE AS score FROM i WHERE module IS NOT NULL AND contains(lower(module), 'kit')")
def imports_substring(spark: SparkSession, d: str) -> DataFrame:
    return symbols.imports(symbols.import_edges(facts.lines(spark, d)), "KIT")


@query("SELECT path, name, line_start FROM s WHERE contains(lower(name), 'voucher') OR contains(lower(name), 'hull')")
def symbol_like_terms(spark: SparkSession, d: str) -> DataFrame:
    return facts.symbols(spark, d).filter(symbols.any_part(F.col("name"), ["voucher", "hull"])).select("path", "name", "line_start")


@query("SELECT symbol_id, CASE WHEN c > 0 THEN 2 * c + 3.0::DOUBLE ELSE 0.0::DOUBLE END AS score_def, CASE WHEN c > 0 THEN 2 * c + 1.5::DOUBLE ELSE 0.0::DOUBLE END AS score_caller FROM (SELECT symbol_id, " + " + ".join(f"CASE WHEN lower(name) = '{t}' THEN 5.0::DOUBLE WHEN len(name) >= 2 AND (contains(lower(name), '{t}') OR contains('{t}', lower(name))) THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END" for t in ("parse", "token")) + " AS c FROM s)")
def score_def(spark: SparkSession, d: str) -> DataFrame:
    rows = facts.symbols(spark, d)
    return rows.select("symbol_id", symbols.score_def(F.col("name"), ["parse", "token"]).alias("score_def"), symbols.score_caller(F.col("name"), ["parse", "token"]).alias("score_caller"))


@query("SELECT path, name, line_start, round(CASE WHEN m > 0 THEN 6.0 * sqrt(m / 2.0) ELSE 0 END, 6) AS score FROM (SELECT *, contains(lower(name), 'voucher')::INT + contains(lower(name), 'store')::INT AS m FROM s WHERE contains(lower(name), 'voucher'))")
def anchor_score(spark: SparkSession, d: str) -> DataFrame:
    return symbols.anchors(facts.symbols(spark, d), "Voucher", ["voucher", "store"])


_RES = """, n AS (SELECT lower(name) AS low, path FROM s), nf AS (SELECT low, path, count(*) AS c FROM n GROUP BY ALL), nr AS (SELECT low, count(*) AS c FROM n GROUP BY ALL),
r AS (SELECT e.path, e.line_no, e.caller, e.callee, e.chunk_id, CASE WHEN nf.c = 1 THEN 'file_local_unique' WHEN nr.c = 1 THEN 'repository_unique' WHEN nr.c IS NULL THEN 'name_only' ELSE 'ambiguous' END AS resolution
FROM e LEFT JOIN nf ON nf.low = lower(e.callee) AND nf.path = e.path LEFT JOIN nr ON nr.low = lower(e.callee))
"""


@query(_RES + "SELECT path, line_no, caller, callee, chunk_id, resolution FROM r")
def resolution_tiers(spark: SparkSession, d: str) -> DataFrame:
    return symbols.resolution(facts.calls(spark, d), facts.symbols(spark, d)).select("path", "line_no", "caller", "callee", "chunk_id", "resolution")


@query(_RES + "SELECT resolution, count(*) AS edges, round(avg(CASE WHEN p.path IS NULL THEN 0.0 ELSE 1.0 END), 3) AS precision FROM (SELECT path, caller, callee, min_by(resolution, list_position(['compiler_resolved', 'import_resolved', 'file_local_unique', 'scip_occurrence', 'repository_unique', 'name_only', 'ambiguous'], resolution)) AS resolution FROM r GROUP BY path, caller, callee) x LEFT JOIN (SELECT DISTINCT path FROM f WHERE language = 'python') p ON p.path = x.path GROUP BY resolution")
def tier_precision(spark: SparkSession, d: str) -> DataFrame:
    edges = symbols.resolution(facts.calls(spark, d), facts.symbols(spark, d))
    gold = edges.filter("language = 'python'")
    return evaluate.tier_precision(edges, gold)


@query(_RES + "SELECT path, line_no, caller, callee, chunk_id, CASE WHEN d.file_id IS NOT NULL AND resolution IN ('repository_unique', 'name_only', 'ambiguous') THEN 'scip_occurrence' ELSE resolution END AS resolution FROM r LEFT JOIN (SELECT DISTINCT file_id, path AS p, line_no AS ln, lower(callee) AS lc FROM e WHERE line_no % 2 = 0) d ON d.p = r.path AND d.ln = r.line_no AND d.lc = lower(r.callee)")
def scip_upgrade(spark: SparkSession, d: str) -> DataFrame:
    calls = facts.calls(spark, d)
    overlay = calls.filter("line_no % 2 = 0").select("path", "line_no", F.col("callee").alias("name"), F.lit(False).alias("is_def"))
    return symbols.scip_upgrade(symbols.resolution(calls, facts.symbols(spark, d)), overlay).select("path", "line_no", "caller", "callee", "chunk_id", "resolution")


@query("SELECT symbol_id, scope FROM (SELECT i.symbol_id, o.name AS scope, row_number() OVER (PARTITION BY i.symbol_id ORDER BY o.byte_end - o.byte_start, o.name) AS r FROM s i JOIN s o ON o.path = i.path AND o.kind = 'class' AND i.kind IN ('function', 'method') AND o.byte_start < i.byte_start AND o.byte_end >= i.byte_end) WHERE r = 1")
def enclosing_scope(spark: SparkSession, d: str) -> DataFrame:
    return symbols.enclosing(facts.symbols(spark, d))


@query("SELECT path, line_no, name FROM (SELECT l.path, l.line_no, s.name, row_number() OVER (PARTITION BY l.path, l.line_no ORDER BY s.line_end - s.line_start, s.line_start, s.name) AS r FROM l JOIN s ON s.path = l.path AND l.line_no BETWEEN s.line_start AND s.line_end WHERE contains(l.content, 'retry')) WHERE r = 1")
def symbol_at_line(spark: SparkSession, d: str) -> DataFrame:
    places = facts.lines(spark, d).filter(text.literal(F.col("content"), "retry"))
    return symbols.tightest(facts.symbols(spark, d), places)


# --- graph --------------------------------------------------------------------------------


@query("SELECT path, line_no, caller, callee FROM e WHERE lower(callee) = 'validate'")
def incoming_calls(spark: SparkSession, d: str) -> DataFrame:
    return graph.incoming(facts.calls(spark, d), "Validate")


@query("SELECT path, line_no, caller, callee FROM e WHERE lower(caller) = 'validate'")
def outgoing_calls(spark: SparkSession, d: str) -> DataFrame:
    return graph.outgoing(facts.calls(spark, d), "Validate")


_EDGES = """, fd AS (SELECT low, path AS target FROM (SELECT lower(name) AS low, path, row_number() OVER (PARTITION BY lower(name) ORDER BY path, byte_start) AS r FROM s) WHERE r <= 8),
g AS (SELECT DISTINCT e.path AS source, fd.target FROM e JOIN fd ON fd.low = lower(e.callee) WHERE e.path <> fd.target),
gb AS (SELECT source AS a, target AS b FROM g UNION SELECT target, source FROM g),
c0 AS (SELECT DISTINCT path AS file, 1.0::DOUBLE AS score, 0 AS hop FROM s WHERE lower(name) = 'parse'),
c1 AS (SELECT b AS file, max(score) * 0.5 AS score, 1 AS hop FROM gb JOIN c0 ON gb.a = c0.file WHERE b NOT IN (SELECT file FROM c0) GROUP BY b)
"""


@query(_EDGES + "SELECT file, score, hop FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1) ORDER BY score DESC, hop, file LIMIT 100")
def chain_one_hop(spark: SparkSession, d: str) -> DataFrame:
    own = facts.symbols(spark, d)
    seeds = own.filter(symbols.same_name(F.col("name"), "parse")).select(F.col("path").alias("file"), F.lit(1.0).alias("score")).distinct()
    return graph.chain(seeds, graph.file_edges(facts.calls(spark, d), own), depth=1)


@query(_EDGES + ", c2 AS (SELECT b AS file, max(score) * 0.5 AS score, 2 AS hop FROM gb JOIN c1 ON gb.a = c1.file WHERE b NOT IN (SELECT file FROM c0) AND b NOT IN (SELECT file FROM c1) GROUP BY b) SELECT file, score, hop FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2) ORDER BY score DESC, hop, file LIMIT 100")
def chain_depth2(spark: SparkSession, d: str) -> DataFrame:
    own = facts.symbols(spark, d)
    seeds = own.filter(symbols.same_name(F.col("name"), "parse")).select(F.col("path").alias("file"), F.lit(1.0).alias("score")).distinct()
    return graph.chain(seeds, graph.file_edges(facts.calls(spark, d), own), depth=2)


_PATHS = """, ed AS (SELECT DISTINCT lower(caller) AS a, lower(callee) AS b FROM e WHERE lower(caller) <> lower(callee)),
un AS (SELECT lower(name) AS n FROM s GROUP BY 1 HAVING count(*) = 1),
tw AS (SELECT x.a, x.b AS via, y.b FROM ed x JOIN un ON un.n = x.b JOIN ed y ON y.a = x.b WHERE y.b <> x.a AND NOT EXISTS (SELECT 1 FROM ed z WHERE z.a = x.a AND z.b = y.b)),
pk AS (SELECT a, b, min(via) AS via FROM tw GROUP BY a, b ORDER BY a, b LIMIT 1)
"""


def _two_hops(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, str, str]:
    """The facts, and the first two names that are two calls apart and not one."""
    calls, own = facts.calls(spark, d), facts.symbols(spark, d)
    edge = calls.select(facts.ascii_lower(F.col("caller")).alias("a"), facts.ascii_lower(F.col("callee")).alias("b")).filter("a <> b").distinct()
    unique = own.groupBy(facts.ascii_lower(F.col("name")).alias("b")).agg(F.count("*").alias("n")).filter("n = 1").select("b")
    far = edge.join(unique, "b", "left_semi").join(edge.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").filter("a <> c")
    ends = far.join(edge.select("a", F.col("b").alias("c")), ["a", "c"], "left_anti").orderBy("a", "c").select("a", "c").first()
    return calls, own, *(ends or ("", ""))


@query(_PATHS + "SELECT 1 AS hop, a AS caller, via AS callee FROM pk UNION ALL SELECT 2, via, b FROM pk")
def call_path_shortest(spark: SparkSession, d: str) -> DataFrame:
    return graph.call_path(*_two_hops(spark, d))


@query(_PATHS + ", hp AS (SELECT 1 AS hop, a AS caller, via AS callee FROM pk UNION ALL SELECT 2, via, b FROM pk), df AS (SELECT lower(name) AS low, count(*) AS n FROM s GROUP BY 1) SELECT hop, caller, callee, CASE WHEN n = 1 THEN 'repository_unique' WHEN n > 1 THEN 'ambiguous' ELSE 'name_only' END AS resolution FROM hp LEFT JOIN df ON df.low = lower(callee)")
def call_path_hops(spark: SparkSession, d: str) -> DataFrame:
    found = _two_hops(spark, d)
    return graph.hops(graph.call_path(*found), found[1]).select("hop", "caller", "callee", "resolution")


# --- fusion over many queries -------------------------------------------------------------

_FUSE = """, hg AS (SELECT * FROM h WHERE score IS NOT NULL AND isfinite(score)),
hb AS (SELECT query_id, file, line_start, kind, max(score) AS score, min(line_end) AS line_end, max(intent) AS intent, max(symbol) AS symbol FROM hg GROUP BY query_id, file, line_start, kind),
hr AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY score DESC, file, line_start, line_end) - 1 AS rank,
 CASE intent WHEN 'conceptual' THEN CASE kind WHEN 'asgrep' THEN 1.1 WHEN 'def' THEN 0.9 WHEN 'graph' THEN 0.7 WHEN 'embed' THEN 1.1 ELSE 1 END WHEN 'symbol' THEN CASE kind WHEN 'asgrep' THEN 1.0 WHEN 'def' THEN 2.0 WHEN 'graph' THEN 0.9 WHEN 'embed' THEN 0.8 ELSE 1 END ELSE 1 END::DOUBLE AS w,
 CASE kind WHEN 'def' THEN 0 WHEN 'graph' THEN 2 WHEN 'asgrep' THEN 6 ELSE 7 END AS p FROM hb),
fu AS (SELECT query_id, file, line_start, round(sum(w / (61.0::DOUBLE + rank)), 9) AS score, arg_min(kind, p) AS kind, arg_min(line_end, p) AS line_end, max(symbol) AS symbol, max(intent) AS intent, list_sort(list(DISTINCT kind)) AS contributors FROM hr GROUP BY query_id, file, line_start)
"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.weighted_rrf(facts.hits(spark, d), ["query_id"])


@query(_FUSE + "SELECT query_id, file, line_start, score, array_to_string(contributors, ',') AS contributors FROM fu")
def weighted_rrf(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "file", "line_start", "score", F.array_join("contributors", ",").alias("contributors"))


@query(_FUSE + "SELECT query_id, file, line_start, kind, line_end FROM fu")
def canonical_kind(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "file", "line_start", "kind", "line_end")


@query(_FUSE + "SELECT query_id, file, line_start, round(score * CASE WHEN list_contains(contributors, 'embed') AND list_contains(contributors, 'graph') AND list_contains(contributors, 'def') THEN 1.25 WHEN list_contains(contributors, 'embed') AND (list_contains(contributors, 'graph') OR list_contains(contributors, 'def')) THEN 1.15 ELSE 1 END::DOUBLE, 9) AS score FROM fu")
def critic_agreement(spark: SparkSession, d: str) -> DataFrame:
    return fusion.critic(_fused(spark, d)).select("query_id", "file", "line_start", "score")


@query("SELECT DISTINCT query_id, file, line_start, line_end, symbol FROM h WHERE kind = 'embed' AND NOT EXISTS (SELECT 1 FROM h o WHERE o.kind <> 'embed' AND o.query_id = h.query_id AND o.file = h.file AND ((h.line_start <= o.line_end AND o.line_start <= h.line_end) OR o.symbol = h.symbol))")
def critic_uncorroborated(spark: SparkSession, d: str) -> DataFrame:
    return fusion.witnessed(facts.hits(spark, d), ["query_id"])


@query(", dd AS (SELECT query_id, file, line_start, line_end, symbol, kind, CASE WHEN score IS NOT NULL AND isfinite(score) THEN score END AS score, signal, coalesce(contributors, [kind]) AS c, CASE kind WHEN 'def' THEN 0 WHEN 'graph' THEN 2 WHEN 'asgrep' THEN 6 ELSE 7 END AS p FROM h) SELECT query_id, file, line_start, line_end, symbol, max(score) AS score, arg_max(kind, (coalesce(score, '-inf'::DOUBLE), -p)) AS kind, CASE max(CASE signal WHEN 'exact' THEN 2 WHEN 'structural' THEN 1 ELSE 0 END) WHEN 2 THEN 'exact' WHEN 1 THEN 'structural' ELSE 'semantic' END AS signal, array_to_string(list_sort(list_distinct(flatten(list(c)))), ',') AS contributors FROM dd GROUP BY query_id, file, line_start, line_end, symbol")
def dedup_merge(spark: SparkSession, d: str) -> DataFrame:
    out = fusion.dedup(facts.hits(spark, d), ["query_id"])
    return out.select("query_id", "file", "line_start", "line_end", "symbol", "score", "kind", "signal", F.array_join("contributors", ",").alias("contributors"))


@query(", hl AS (SELECT query_id, signal, score, count(*) AS ties FROM h WHERE score IS NOT NULL AND isfinite(score) GROUP BY ALL), hm AS (SELECT *, score - lead(score) OVER (PARTITION BY query_id, signal ORDER BY score DESC) AS gap FROM hl) SELECT h.hit_id, CASE WHEN hm.score IS NULL THEN NULL WHEN ties = 1 AND gap IS NOT NULL THEN round(gap, 9) ELSE 0.0 END AS margin FROM h LEFT JOIN hm ON hm.query_id = h.query_id AND hm.signal IS NOT DISTINCT FROM h.signal AND hm.score = h.score AND isfinite(h.score)")
def signal_margin(spark: SparkSession, d: str) -> DataFrame:
    return fusion.margins(facts.hits(spark, d), ["query_id"]).select("hit_id", "margin")


@query("SELECT hit_id, round(least(0.99, CASE signal WHEN 'exact' THEN 0.75 WHEN 'structural' THEN 0.60 ELSE 0.35 END::DOUBLE + 0.08 * least(greatest(coalesce(len(contributors), 0) - 1, 0), 3)), 6) AS confidence FROM h")
def confidence(spark: SparkSession, d: str) -> DataFrame:
    return facts.hits(spark, d).select("hit_id", fusion.confidence(F.col("signal"), F.coalesce("contributors", F.array().cast("array<string>"))).alias("confidence"))


_FINAL = ", fn AS (SELECT *, row_number() OVER (PARTITION BY query_id, file ORDER BY score DESC, file, line_start) AS nth FROM fu), fp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(nth > 3 AS INT), score DESC, file, line_start) AS position FROM fn)\n"


@query(_FUSE + _FINAL + "SELECT query_id, file, line_start, position FROM fp")
def per_file_cap(spark: SparkSession, d: str) -> DataFrame:
    return fusion.per_file_cap(_fused(spark, d), ["query_id"]).select("query_id", "file", "line_start", F.col("position").cast("long").alias("position"))


@query(_FUSE + _FINAL + ", fb AS (SELECT *, max(CAST(kind = 'def' AND position <= 2 AS INT)) OVER (PARTITION BY query_id) AS hd, min(CASE WHEN kind = 'def' THEN position END) OVER (PARTITION BY query_id) AS bd FROM fp) SELECT query_id, file, line_start, CASE WHEN hd = 0 AND position = bd THEN 2 WHEN hd = 0 AND bd IS NOT NULL AND position BETWEEN 2 AND bd - 1 THEN position + 1 ELSE position END AS position FROM fb")
def definition_promotion(spark: SparkSession, d: str) -> DataFrame:
    placed = fusion.per_file_cap(_fused(spark, d), ["query_id"])
    return fusion.promote_definition(placed, ["query_id"], 2).select("query_id", "file", "line_start", F.col("position").cast("long").alias("position"))


@query(_FUSE + _FINAL + ", gd AS (SELECT DISTINCT query_id, file, line_start FROM h WHERE kind = 'def'), gn AS (SELECT query_id, count(*) AS n FROM gd GROUP BY query_id), gf AS (SELECT fp.query_id, min(position) AS first, sum(1.0 / log2(position + 1.0)) AS dcg, sum(CAST(position <= 5 AS INT)) AS r5 FROM fp JOIN gd USING (query_id, file, line_start) GROUP BY fp.query_id) SELECT gn.query_id, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1.0 / log2(i + 1.0))), 0), 6) AS ndcg, round(coalesce(r5::DOUBLE / n, 0), 6) AS recall_5 FROM gn LEFT JOIN gf USING (query_id)")
def eval_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    placed = fusion.per_file_cap(_fused(spark, d), ["query_id"])
    gold = facts.hits(spark, d).filter("kind = 'def'")
    return evaluate.ranking(placed, gold, ["query_id"], ["file", "line_start"]).select("query_id", "mrr", "ndcg", "recall_5")


@query(", fs AS (SELECT path AS file, sum(strlen(content) + 1) AS bytes FROM l GROUP BY path), a AS (SELECT query_id, sum(bytes) AS bytes FROM (SELECT DISTINCT query_id, file FROM h) JOIN fs USING (file) GROUP BY query_id), b AS (SELECT query_id, sum(coalesce(strlen(symbol), 0)) AS shown FROM h GROUP BY query_id) SELECT query_id, CAST(greatest(bytes - shown, 0) AS BIGINT) AS prevented FROM a JOIN b USING (query_id)")
def prevented_reads(spark: SparkSession, d: str) -> DataFrame:
    sizes = facts.lines(spark, d).groupBy(F.col("path").alias("file")).agg(F.sum(F.octet_length("content") + 1).alias("bytes"))
    return evaluate.prevented_reads(facts.hits(spark, d).withColumn("excerpt", F.col("symbol")), sizes, ["query_id"])


# --- set operations -----------------------------------------------------------------------

_AB = ", a AS (SELECT DISTINCT path AS file, line_start, line_end, 'def' AS kind FROM s WHERE contains(lower(name), 'voucher')), b AS (SELECT DISTINCT path AS file, line_no AS line_start, line_no AS line_end, 'asgrep' AS kind FROM l WHERE contains(content, 'retry'))\n"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = facts.symbols(spark, d).filter(symbols.any_part(F.col("name"), ["voucher"])).select(F.col("path").alias("file"), "line_start", "line_end", F.lit("def").alias("kind")).distinct()
    b = facts.lines(spark, d).filter(text.literal(F.col("content"), "retry")).select(F.col("path").alias("file"), F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), F.lit("asgrep").alias("kind"))
    return a, b


@query(_AB + "SELECT * FROM a WHERE file IN (SELECT file FROM b)")
def and_file(spark: SparkSession, d: str) -> DataFrame:
    return conjunction.and_file(*_sides(spark, d))


@query(_AB + "SELECT * FROM a WHERE file NOT IN (SELECT file FROM b)")
def and_not_file(spark: SparkSession, d: str) -> DataFrame:
    return conjunction.and_file(*_sides(spark, d), negated=True)


@query(_AB + "SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.file = a.file AND a.line_start <= b.line_end AND b.line_start <= a.line_end)")
def and_span(spark: SparkSession, d: str) -> DataFrame:
    return conjunction.and_span(*_sides(spark, d))


@query(_AB + "SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.file = a.file AND a.line_start <= b.line_end AND b.line_start <= a.line_end)")
def and_not_span(spark: SparkSession, d: str) -> DataFrame:
    return conjunction.and_span(*_sides(spark, d), negated=True)


@query(_AB + ", m AS (SELECT a.*, row_number() OVER (PARTITION BY b.file, b.line_start ORDER BY a.line_start, a.line_end) AS n FROM a JOIN b ON b.file = a.file AND a.line_start <= b.line_end AND b.line_start <= a.line_end) SELECT a.file, a.line_start, a.line_end, CASE WHEN EXISTS (SELECT 1 FROM m WHERE n = 1 AND m.file = a.file AND m.line_start = a.line_start AND m.line_end = a.line_end) THEN 'asgrep,def' ELSE 'def' END AS contributors FROM a")
def evidence_merge(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    out = conjunction.merge_evidence(a.withColumn("contributors", F.array("kind")), b)
    return out.select("file", "line_start", "line_end", F.array_join("contributors", ",").alias("contributors"))


# --- vectors ------------------------------------------------------------------------------

_COS = "list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q)))"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").orderBy("vec_id").limit(1).first()["embedding"]


@query(f"WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round({_COS}, 6) AS sim FROM embeddings, q WHERE {_COS} > 0.08 ORDER BY {_COS} DESC, vec_id LIMIT 20", views=False)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(table(spark, d, "embeddings"), _query_vector(spark, d), "vec_id", "embedding", 20).select("vec_id", F.round("sim", 6).alias("sim"))


@query(f"WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT count(*) AS n, sum(CAST({_COS} > 0.08 AS INT))::BIGINT AS above FROM embeddings, q", views=False)
def min_similarity_gate(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, d)])
    above = vectors.cosine(F.col("embedding"), q) > vectors.MIN_SIMILARITY
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.sum(above.cast("long")).alias("above"))


@query(f"WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), r AS (SELECT label, vec_id, {_COS} AS sim, row_number() OVER (PARTITION BY label ORDER BY {_COS} DESC, vec_id::VARCHAR) AS n FROM embeddings, q) SELECT label, round(max(sim), 6) AS sim, string_agg(vec_id::VARCHAR, chr(10) || '...' || chr(10) ORDER BY n) AS excerpt FROM r WHERE n <= 3 GROUP BY label", views=False)
def parent_group_top3(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, d)])
    rows = table(spark, d, "embeddings").select("label", F.col("vec_id").cast("string").alias("text"), vectors.cosine(F.col("embedding"), q).alias("sim"))
    return vectors.parents(rows, ["label"], "text").select("label", F.round("sim", 6).alias("sim"), "excerpt")




@query(", w AS (SELECT * FROM field_weights), x AS (SELECT hit_id, score, [v FOR v IN [(embed_fields.name::DOUBLE, w.name::DOUBLE), (embed_fields.docs::DOUBLE, w.docs::DOUBLE), (embed_fields.body::DOUBLE, w.body::DOUBLE), (embed_fields.graph::DOUBLE, w.graph::DOUBLE), (embed_fields.tests_examples::DOUBLE, w.tests_examples::DOUBLE)] IF v[1] IS NOT NULL AND NOT isnan(v[1]) AND v[2] > 0] AS p FROM h JOIN w ON w.intent = h.intent WHERE kind = 'embed') SELECT hit_id, round(CASE WHEN len(p) > 0 THEN list_sum([v[1] * v[2] FOR v IN p]) / list_sum([v[2] FOR v IN p]) ELSE score END, 6) AS mix FROM x")
def field_mix(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "field_weights").select("intent", F.struct(*vectors.FIELDS).alias("weights"))
    rows = facts.hits(spark, d).filter("kind = 'embed'").join(F.broadcast(w), "intent")
    return rows.select("hit_id", F.round(vectors.field_mix(F.col("embed_fields"), F.col("weights"), F.col("score")), 6).alias("mix"))


@query()
def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    return facts.documents(spark, d).select("doc_id", vectors.embed_hashed("text").alias("vector"))


# --- lexicon ------------------------------------------------------------------------------

_PPMI = """, o0 AS (SELECT chunk_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(symbol_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^\\p{L}\\p{N}]+'), lambda x: lower(x)), lambda x: len(x) BETWEEN 3 AND 64 AND NOT list_contains(['the', 'and', 'for', 'with', 'from', 'this', 'that', 'into', 'are', 'was', 'not', 'has', 'its', 'get', 'set'], x)) AS i, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(doc, ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^\\p{L}\\p{N}]+'), lambda x: lower(x)), lambda x: len(x) BETWEEN 3 AND 64 AND NOT list_contains(['the', 'and', 'for', 'with', 'from', 'this', 'that', 'into', 'are', 'was', 'not', 'has', 'its', 'get', 'set'], x)) AS p FROM k WHERE symbol_name IS NOT NULL),
o AS (SELECT chunk_id, i, list_distinct(list_concat(i, p)) AS c FROM (SELECT chunk_id, list_slice(list_filter(i, lambda x, n: list_position(i, x) = n), 1, 8) AS i, list_slice(list_filter(p, lambda x, n: list_position(p, x) = n), 1, 64) AS p FROM o0)),
pr AS (SELECT a AS term, b AS related, count(*) AS support FROM (SELECT a, unnest(c) AS b FROM (SELECT unnest(i) AS a, c FROM o WHERE len(i) > 0 AND len(c) >= 2)) WHERE a <> b GROUP BY ALL),
pp AS (SELECT term, related, round(ln(support * n / (nt * nr)), 6) AS ppmi, support FROM pr JOIN (SELECT term, sum(support)::DOUBLE AS nt FROM pr GROUP BY term) USING (term) JOIN (SELECT related, sum(support)::DOUBLE AS nr FROM pr GROUP BY related) USING (related), (SELECT sum(support)::DOUBLE AS n FROM pr) WHERE support >= 3)
"""


def _associations(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.ppmi(lexicon.observations(facts.chunks(spark, d).filter("symbol_name IS NOT NULL")))


@query(_PPMI + "SELECT * FROM pp WHERE ppmi > 0")
def ppmi_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _associations(spark, d)


@query(_PPMI + "SELECT term, related, ppmi, support FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY ppmi DESC, support DESC, related) AS r FROM pp WHERE ppmi > 0) WHERE r <= 8")
def ppmi_top8(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.top(_associations(spark, d))


@query(_PPMI + "SELECT related, max(ppmi) AS ppmi FROM (SELECT term, related, ppmi FROM pp WHERE ppmi > 0 UNION ALL SELECT related, term, ppmi FROM pp WHERE ppmi > 0) WHERE term = 'voucher' AND related <> 'voucher' GROUP BY related ORDER BY ppmi DESC, related LIMIT 5")
def expand_terms(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.expand(_associations(spark, d), ["voucher"])


# --- cascade ------------------------------------------------------------------------------

_PRE = """, ev AS (SELECT * FROM (SELECT t AS term, path AS file, line_no AS line_start, row_number() OVER (PARTITION BY t ORDER BY path, line_no) AS r FROM l, (SELECT unnest(['retry', 'rotated', 'window']) AS t) WHERE contains(lower(content), t)) WHERE r <= 100),
tf AS (SELECT file, round(sum(1.0::DOUBLE / (1.0 + 0.01 * (r - 1)) * len(term)), 6) AS weight FROM ev GROUP BY file ORDER BY weight DESC, file LIMIT 100)
"""
_TERMS = ["retry", "rotated", "window"]


@query(_PRE + "SELECT file, weight FROM tf")
def prefilter_top_files(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.top_files(hybrid.prefilter(facts.lines(spark, d), _TERMS))


@query(_PRE + "SELECT s.path, s.name, s.line_start FROM s WHERE s.path IN (SELECT file FROM tf) AND (" + " OR ".join(f"contains(lower(name), '{t}')" for t in ("retry", "rotated", "window")) + ")")
def cascade_semi_join(spark: SparkSession, d: str) -> DataFrame:
    files = hybrid.top_files(hybrid.prefilter(facts.lines(spark, d), _TERMS)).select(F.col("file").alias("path"))
    own = facts.symbols(spark, d).filter(symbols.any_part(F.col("name"), _TERMS))
    return own.join(F.broadcast(files), "path", "left_semi").select("path", "name", "line_start")


@query(_PRE + ", st AS (SELECT DISTINCT path AS file FROM s WHERE path IN (SELECT file FROM tf) AND contains(lower(name), 'rotated')) SELECT file FROM st UNION ALL SELECT file FROM tf WHERE (SELECT count(*) FROM st) = 0")
def working_set_fallback(spark: SparkSession, d: str) -> DataFrame:
    files = hybrid.top_files(hybrid.prefilter(facts.lines(spark, d), _TERMS))
    inside = facts.symbols(spark, d).filter(symbols.any_part(F.col("name"), ["rotated"])).join(F.broadcast(files.select(F.col("file").alias("path"))), "path", "left_semi")
    return hybrid.working_files(files, inside.select(F.col("path").alias("file")))


@query(", p AS (SELECT symbol, max(score) AS s FROM h WHERE kind = 'embed' AND symbol IS NOT NULL AND score IS NOT NULL AND isfinite(score) GROUP BY symbol ORDER BY s DESC, symbol LIMIT 4) SELECT file, line_start, symbol FROM (SELECT e.path AS file, e.line_no AS line_start, e.callee AS symbol, row_number() OVER (PARTITION BY e.callee ORDER BY e.path, e.line_no, e.caller) AS r FROM e JOIN p ON p.symbol = e.callee) WHERE r <= 16")
def conceptual_fanout(spark: SparkSession, d: str) -> DataFrame:
    embed = facts.hits(spark, d).filter(F.col("kind") == "embed").filter(fusion.finite(F.col("score")))
    return hybrid.fanout(embed, facts.calls(spark, d)).filter("kind = 'graph'").select("file", "line_start", "symbol")


@query()
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    texts = facts.chunks(spark, d).select("path", "line_start", "line_end", "symbol_name", chunks.rendered().alias("text"))
    return hybrid.search("retry window kept", facts.lines(spark, d), facts.symbols(spark, d), facts.calls(spark, d), texts, associations=_associations(spark, d))


# --- inverted file of vectors -------------------------------------------------------------


def _ivf(spark: SparkSession, d: str):
    import numpy as np

    rows = table(spark, d, "embeddings")
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4096).select("embedding").collect()], float)
    centroids = vectors.ivf_fit(sample, rows.count())
    return vectors.ivf_assign(rows, "vec_id", "embedding", centroids), centroids


@query()
def ivf_assign(spark: SparkSession, d: str) -> DataFrame:
    return _ivf(spark, d)[0].select("vec_id", "cell")


@query()
def ivf_probe_topk(spark: SparkSession, d: str) -> DataFrame:
    assigned, centroids = _ivf(spark, d)
    return vectors.ivf_search(assigned, _query_vector(spark, d), "vec_id", "embedding", centroids, 10).select("vec_id", F.round("sim", 6).alias("sim"))


# --- extraction and structure -------------------------------------------------------------


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return facts.sources(spark, d)


@query()
def extract_facts(spark: SparkSession, d: str) -> DataFrame:
    return extract.extract(_sources(spark, d))


@query()
def pattern_match(spark: SparkSession, d: str) -> DataFrame:
    return extract.match_pattern(_sources(spark, d), "def $NAME($$$)")


@query()
def codemod_plan(spark: SparkSession, d: str) -> DataFrame:
    return extract.codemod(_sources(spark, d), "render($$$)", "draw_$MATCH")


@query("SELECT path, line_no, coalesce(doc, '') AS doc, scope FROM (SELECT path, line_start AS line_no, doc, scope FROM k WHERE kind IN ('function', 'method'))")
def semantic_chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return facts.chunks(spark, d).filter("kind IN ('function', 'method')").select("path", F.col("line_start").alias("line_no"), F.coalesce("doc", F.lit("")).alias("doc"), "scope")


@query("SELECT chunk_id, CASE WHEN length(trim(symbol_name)) > 0 THEN symbol_name END AS name, CASE WHEN length(trim(doc)) > 0 THEN doc END AS docs, CASE WHEN length(trim(excerpt)) > 0 THEN excerpt END AS body FROM k")
def chunk_fields(spark: SparkSession, d: str) -> DataFrame:
    return chunks.fields(facts.chunks(spark, d)).select("chunk_id", "name", "docs", "body")


@query("SELECT chunk_id, concat_ws(chr(10), CASE WHEN length(trim(excerpt)) > 0 THEN 'excerpt: ' || excerpt END, CASE WHEN length(trim(symbol_name)) > 0 THEN 'symbol: ' || symbol_name END, CASE WHEN length(trim(kind)) > 0 THEN 'kind: ' || kind END, CASE WHEN length(trim(scope)) > 0 THEN 'scope: ' || scope END, CASE WHEN length(trim(doc)) > 0 THEN 'doc: ' || doc END, CASE WHEN len(callers) > 0 THEN 'called_by: ' || array_to_string(list_sort(callers), ' ') END, CASE WHEN len(callees) > 0 THEN 'calls: ' || array_to_string(list_sort(callees), ' ') END) AS text FROM k")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    return facts.chunks(spark, d).select("chunk_id", chunks.rendered().alias("text"))


@query()
def module_resolution(spark: SparkSession, d: str) -> DataFrame:
    return chunks.resolve_imports(symbols.import_edges(facts.lines(spark, d)), facts.files(spark, d))


@query("""SELECT path, sha256('[' || string_agg('"' || h || '"', ',' ORDER BY h) || ']') AS structure FROM (SELECT path, sha256('{"kind":"' || kind || '","line_end":' || line_end || ',"line_start":' || line_start || ',"name":"' || name || '"}') AS h FROM s) GROUP BY path""")
def structure_hash(spark: SparkSession, d: str) -> DataFrame:
    return chunks.structure_hash(facts.symbols(spark, d).select("path", "name", "kind", "line_start", "line_end"))


# --- incremental --------------------------------------------------------------------------

_INC = """, o AS (SELECT path, content_hash FROM f WHERE file_id % 3 <> 0), nw AS (SELECT path, CASE WHEN file_id % 5 = 0 THEN content_hash || 'x' ELSE content_hash END AS content_hash FROM f)
"""


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = facts.files(spark, d)
    old = own.filter("file_id % 3 <> 0").select("path", "language", "content_hash", F.lit("").alias("identity"))
    new = own.select("path", "language", F.when(F.col("file_id") % 5 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"), F.lit("").alias("identity"))
    return old, new


@query(_INC + "SELECT nw.path FROM nw JOIN o ON o.path = nw.path AND o.content_hash = nw.content_hash")
def unchanged_skip(spark: SparkSession, d: str) -> DataFrame:
    old, new = _states(spark, d)
    return generations.unchanged(new, old).select("path")


@query(_INC + ", ch AS (SELECT * FROM nw WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = nw.path AND o.content_hash = nw.content_hash)) SELECT path, content_hash FROM o WHERE path NOT IN (SELECT path FROM ch) UNION ALL SELECT path, content_hash FROM ch")
def upsert_generation(spark: SparkSession, d: str) -> DataFrame:
    old, new = _states(spark, d)
    return generations.upsert(old, generations.changed(new, old)).select("path", "content_hash")


@query("SELECT path FROM f WHERE file_id % 2 = 0 OR language IS DISTINCT FROM 'python'")
def prune_missing(spark: SparkSession, d: str) -> DataFrame:
    own = facts.files(spark, d)
    return generations.prune(own, own.filter("file_id % 2 = 0"), True, "python").select("path")


# --- a search as it is run ----------------------------------------------------------------


def _mode(spark: SparkSession, d: str, raw: str, most: int | None = None) -> DataFrame:
    out = search.channel(index.over(spark, d), parse(raw), search.Options(limit=most))
    return out.select("kind", "file", "line_start", "line_end", "symbol", "score")


@query(f"SELECT 'def' AS kind, path AS file, line_start, line_end, name AS symbol, (2 * {_DEF} + 3.0::DOUBLE) * CASE WHEN kind IN ('function', 'method') THEN 1.0::DOUBLE ELSE 0.65::DOUBLE END AS score FROM (SELECT * FROM s WHERE lower(name) = 'parse' ORDER BY CASE WHEN kind IN ('function', 'method') THEN 0 ELSE 1 END, path, byte_start LIMIT 500)")
def mode_defs(spark: SparkSession, d: str) -> DataFrame:
    return _mode(spark, d, "defs:Parse")


@query(_RES + "SELECT unnest(['caller', 'graph']) AS kind, path AS file, line_no AS line_start, line_no AS line_end, unnest([caller, callee]) AS symbol, unnest([2 * 5.0::DOUBLE + 1.5, 5.0::DOUBLE]) AS score, resolution FROM (SELECT path, line_no, caller, callee, min(resolution) AS resolution, chunk_id FROM r WHERE lower(callee) = 'render' GROUP BY path, line_no, caller, callee, chunk_id ORDER BY path, line_no, caller, callee LIMIT 500)")
def mode_callers(spark: SparkSession, d: str) -> DataFrame:
    out = search.channel(index.over(spark, d), parse("callers:render"))
    return out.select("kind", "file", "line_start", "line_end", "symbol", "score", "resolution")


@query(_IMPORTS + "SELECT 'import' AS kind, path AS file, line_no AS line_start, line_no AS line_end, module AS symbol, 2.0::DOUBLE AS score FROM i WHERE module IS NOT NULL AND contains(lower(module), 'kit')")
def mode_imports(spark: SparkSession, d: str) -> DataFrame:
    return _mode(spark, d, "imports:KIT")


@query("SELECT 'asgrep' AS kind, path AS file, line_no AS line_start, line_no AS line_end, NULL::VARCHAR AS symbol, 1.0::DOUBLE AS score FROM l WHERE contains(lower(content), 'retry') ORDER BY path, line_no LIMIT 1000")
def mode_literal(spark: SparkSession, d: str) -> DataFrame:
    return _mode(spark, d, "literal:RETRY", 1000)


@query("SELECT 'asgrep' AS kind, path AS file, line_no AS line_start, line_no AS line_end, NULL::VARCHAR AS symbol, 1.0::DOUBLE AS score FROM l WHERE regexp_matches(content, '(^|[^\\p{L}\\p{N}_])token($|[^\\p{L}\\p{N}_])') ORDER BY path, line_no LIMIT 200")
def mode_word(spark: SparkSession, d: str) -> DataFrame:
    return _mode(spark, d, "word:token")


@query("SELECT 'asgrep' AS kind, path AS file, line_no AS line_start, line_no AS line_end, NULL::VARCHAR AS symbol, 1.0::DOUBLE AS score FROM l WHERE regexp_matches(content, 'return [0-9]+') ORDER BY path, line_no LIMIT 200")
def mode_regex(spark: SparkSession, d: str) -> DataFrame:
    return _mode(spark, d, "regex:return [0-9]+")


@query("SELECT 'asgrep' AS kind, path AS file, line_no AS line_start, line_no AS line_end, NULL::VARCHAR AS symbol, 1.0::DOUBLE AS score FROM l WHERE contains(lower(content), 'in the') ORDER BY path, line_no LIMIT 200")
def mode_quoted(spark: SparkSession, d: str) -> DataFrame:
    return _mode(spark, d, '"in the"')


@query("SELECT path AS file, line_no AS line_start, 'asgrep' AS kind FROM l WHERE contains(lower(content), 'retry') AND path IN (SELECT path FROM s WHERE lower(name) = 'parse')")
def conj_file(spark: SparkSession, d: str) -> DataFrame:
    return search.conjunct(index.over(spark, d), parse_conjunction("literal:retry AND defs:parse")).select("file", "line_start", "kind")


@query("SELECT path AS file, line_no AS line_start, 'asgrep' AS kind FROM l WHERE contains(lower(content), 'retry') AND path NOT IN (SELECT path FROM s WHERE lower(name) = 'parse')")
def conj_not_file(spark: SparkSession, d: str) -> DataFrame:
    return search.conjunct(index.over(spark, d), parse_conjunction("literal:retry AND NOT defs:parse")).select("file", "line_start", "kind")


@query()
def conj_span(spark: SparkSession, d: str) -> DataFrame:
    """Python functions around a call of ``render``."""
    own = facts.sources(spark, d)
    nodes = (own, structure.nodes(extract.extract(own)))
    return search.conjunct(index.over(spark, d), parse_conjunction("pattern:def $NAME($$$) AND callers:render"), nodes=nodes).select("file", "line_start", "line_end", "kind")


_FULL = f""", d0 AS (SELECT path AS file, line_start, line_end, name AS symbol, max((2 * {_DEF} + 3.0::DOUBLE) * CASE WHEN kind IN ('function', 'method') THEN 1.0::DOUBLE ELSE 0.65::DOUBLE END) AS score FROM (SELECT * FROM s WHERE lower(name) = 'parse' ORDER BY CASE WHEN kind IN ('function', 'method') THEN 0 ELSE 1 END, path, byte_start LIMIT 500) GROUP BY ALL),
d1 AS (SELECT *, CASE WHEN lower(symbol) = 'parse' THEN 1 ELSE 0 END AS coverage FROM d0),
d2 AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, coverage DESC, file, line_start, line_end, symbol) AS nth FROM d1)
"""


@query(_FULL + "SELECT position, file, line_start, symbol, score, 0.6::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (ORDER BY (nth > 3)::INT, score DESC, coverage DESC, file, line_start, line_end, symbol) AS position FROM d2) WHERE position <= 16")
def search_full(spark: SparkSession, d: str) -> DataFrame:
    out = search.search(index.over(spark, d), "defs:parse")
    return out.select(F.col("position").cast("long").alias("position"), "file", "line_start", "symbol", "score", "confidence")


@query("SELECT 'files' AS name, count(*) AS rows FROM f UNION ALL SELECT 'lines', count(*) FROM l UNION ALL SELECT 'symbols', count(*) FROM s UNION ALL SELECT 'calls', count(*) FROM e UNION ALL SELECT 'chunks', count(*) FROM k")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    """The rows of each fact table of an index."""
    held, out = index.over(spark, d), None
    for name in ("files", "lines", "symbols", "calls", "chunks"):
        one = getattr(held, name).agg(F.lit(name).alias("name"), F.count("*").alias("rows")).select("name", "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT path, count(*) AS n FROM s WHERE lower(name) = 'parse' GROUP BY path")
def symbols_by_file(spark: SparkSession, d: str) -> DataFrame:
    return symbols.per_file(facts.symbols(spark, d), "parse")


@query("SELECT s.symbol_id, string_agg(substr(l.content, 1, 1600), ' ' ORDER BY l.line_no) AS text FROM s JOIN l ON l.path = s.path AND l.line_no BETWEEN s.line_start AND s.line_end GROUP BY s.symbol_id")
def symbol_texts(spark: SparkSession, d: str) -> DataFrame:
    return symbols.texts(table(spark, d, "symbols").distinct(), table(spark, d, "source_lines"), facts.files(spark, d))


@query("SELECT count(*) AS n, max(line_no) AS last_line, max(length(content)) AS longest FROM l")
def line_scalars(spark: SparkSession, d: str) -> DataFrame:
    return facts.lines(spark, d).agg(F.count("*").alias("n"), F.max("line_no").alias("last_line"), F.max(F.length("content")).cast("long").alias("longest"))


@query()
def built_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Semantic chunks built from the extracted facts of every file."""
    return structure.build_chunks(extract.extract(facts.sources(spark, d)), facts.lines(spark, d))


@query()
def structural_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The structural index asked by signature and united with the native scan."""
    own = facts.sources(spark, d)
    return structure.find(structure.nodes(extract.extract(own)), own, "def parse").select("file", "line_start", "line_end", "symbol", "score", "excerpt")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The cascade from lines to fused, capped and ordered hits over all logged queries."""
    fused = fusion.critic(_fused(spark, d))
    placed = fusion.per_file_cap(fused, ["query_id"])
    return placed.select("query_id", "position", "file", "line_start", "line_end", "kind", "score", "contributors", "critic")
