"""Problem 4: one ranking from several differently-scaled scores.

Outranking net flow. Each score of a group is turned into percentiles, so its range
no longer matters. An item is preferred to another on one score by how far its
percentile is ahead: not at all from 0, fully from ``threshold`` on, linear between.
The mean preference over all others, minus the mean preference of all others over it,
is the item's flow on that score; weighted means of the flows give the net flow.

No pair is formed: with the values sorted, the sum of preferences of an item is read
off prefix sums (count and sum of percentiles) at its own percentile and at its
percentile minus and plus the threshold. All rows of a group are brought together by one
shuffle, and the prefix sums are windows over it. Groups too large for a task (one may hold
a third of all rows) take distributed prefix sums instead; both ways give the same flows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark.functions.prefix import crowded, numbered, prefix_sums
from siftspark.session import checkpoint
from siftspark.sources.tables import table

THRESHOLD = 0.25
TOP = 3
SCALE = 10**12  # percentiles as whole numbers, for range windows
PER_TASK = 200_000  # rows of a group that one task sorts
KINDS = ("asgrep", "def", "graph", "embed")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _flow(plus: Column, minus: Column) -> Column:
    return F.when(F.col("n") > 1, (plus - minus) / (F.col("n") - 1)).otherwise(F.lit(0.0))


def _percentile(below: str) -> Column:
    return F.when(F.col("n") > 1, (F.col(below) + (F.col("cnt") - 1) / 2) / (F.col("n") - 1)).otherwise(F.lit(0.5))


def _net(x: Column, t: Column) -> Column:
    """Preferences over others less preferences of others, from counts and sums of percentiles.

    ``cl, sl`` up to the lower probe, ``c, s`` below the value, ``cu, su`` up to the upper probe.
    """
    plus = F.col("cl") + ((F.col("c") - F.col("cl")) * x - (F.col("s") - F.col("sl"))) / t
    within = F.col("cu") - F.col("c") - F.col("cnt")
    minus = (F.col("n") - F.col("cu")) + ((F.col("su") - F.col("s") - F.col("cnt") * x) - within * x) / t
    return _flow(plus, minus)


def _within(rows: DataFrame, group: list[str], key: list[str], threshold: float, top: int) -> DataFrame:
    """``flow, leads, heads`` of each row by windows; ``heads`` marks one row of each criterion."""
    by_key = Window.partitionBy(*key)
    up, peers = by_key.orderBy("value"), by_key.orderBy("value").rangeBetween(Window.currentRow, Window.currentRow)
    placed = rows.withColumns({"below": F.rank().over(up) - 1, "cnt": F.count("*").over(peers), "n": F.count("*").over(by_key), "nth": F.row_number().over(up)})
    placed = placed.withColumn("pct", _percentile("below")).withColumn("at", F.round(F.col("pct") * SCALE).cast("long"))
    step = int(threshold * SCALE)  # the preference is continuous at the probes, so their rounding does no harm
    reach = lambda to: by_key.orderBy("at").rangeBetween(Window.unboundedPreceding, to)
    sums = lambda name, to: {f"c{name}": F.count("*").over(reach(to)), f"s{name}": F.sum("pct").over(reach(to))}
    placed = placed.withColumns(sums("l", -step) | sums("e", Window.currentRow) | sums("u", step))
    placed = placed.withColumns({"c": F.col("ce") - F.col("cnt"), "s": F.col("se") - F.col("cnt") * F.col("pct"), "sl": F.coalesce("sl", F.lit(0.0))})
    leads = (F.col("n") - F.col("below") - F.col("cnt") < top).cast("int")
    return placed.withColumns({"flow": _net(F.col("pct"), F.lit(threshold)), "leads": leads, "heads": (F.col("nth") == 1).cast("int")})


def _spread(rows: DataFrame, key: list[str], threshold: float, top: int) -> DataFrame:
    """``flow, leads`` of each row of groups that span tasks, by distributed prefix sums over their distinct values."""
    ties = rows.groupBy(*key, "value").agg(F.count("*").alias("cnt"))
    sized = ties.join(ties.groupBy(*key).agg(F.sum("cnt").alias("n")), key)  # a row per value, not per item
    ranked = prefix_sums(sized, key, ["value"], {"below": F.col("cnt")})
    ranked = ranked.withColumn("pct", _percentile("below")).withColumn("above", F.col("n") - F.col("below") - F.col("cnt"))
    # at each sorted position: 0 the upper probe, 1 the value, 2 the lower probe (which takes in an equal value)
    points = F.array(
        F.struct((F.col("pct") - threshold).alias("at"), F.lit(2).alias("part"), F.lit(0).cast("long").alias("c")),
        F.struct(F.col("pct").alias("at"), F.lit(1).alias("part"), F.col("cnt").alias("c")),
        F.struct((F.col("pct") + threshold).alias("at"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("c")),
    )
    events = ranked.select(*key, "value", "pct", "cnt", "n", "above", F.inline(points)).withColumn("at", F.round("at", 12))
    summed = prefix_sums(events, key, ["at", "part", "value"], {"c0": F.col("c"), "s0": F.col("c") * F.col("at")})
    take = lambda part, what: F.max(F.when(F.col("part") == part, F.col(what)))
    flows = summed.groupBy(*key, "value").agg(
        F.first("pct").alias("x"), F.first("cnt").alias("cnt"), F.first("n").alias("n"), F.first("above").alias("above"),
        take(2, "c0").alias("cl"), take(2, "s0").alias("sl"), take(1, "c0").alias("c"), take(1, "s0").alias("s"), take(0, "c0").alias("cu"), take(0, "s0").alias("su"),
    )
    flows = flows.select(*key, "value", _net(F.col("x"), F.lit(threshold)).alias("flow"), (F.col("above") < top).cast("int").alias("leads"))
    return rows.join(flows, [*key, "value"])


def _items(scored: DataFrame, group: list[str], item: list[str]) -> DataFrame:
    return scored.groupBy(*group, *item).agg(F.sum("leads").cast("long").alias("led"), F.sum(F.col("flow") * F.col("weight")).alias("wf"))


def net_flow(scores: DataFrame, group: list[str], item: list[str], threshold: float = THRESHOLD, top: int = TOP, per_task: int = PER_TASK) -> DataFrame:
    """Rank the items of each group by outranking net flow.

    ``scores`` is long: ``<group>, <item>, criterion, value, weight``. Returns a row per
    group and item: ``criteria`` (of the group), ``led`` (criteria in which fewer than
    ``top`` items have a larger value), ``flow`` (rounded to six places) and ``rank`` from 1 by
    the flow, then the item's key. Null, NaN and infinite values and weights of zero or less
    take no part; an item missing under a criterion has no flow there; an item with no value
    at all gives no row. A repeated (group, item, criterion) counts once with its largest
    value. An empty table gives an empty result. Extra columns are ignored. Groups of more
    than ``per_task`` rows are spread over tasks.
    """
    key = [*group, "criterion"]
    value = F.col("value").cast("double")
    base = scores.select(*key, *item, "value", "weight").filter(finite(value) & (F.col("weight") > 0))

    def largest(rows: DataFrame) -> DataFrame:
        out = rows.groupBy(*key, *item).agg(F.max(value).alias("value"), F.max(F.col("weight").cast("double")).alias("weight"))
        return out.withColumn("value", F.col("value") + F.lit(0.0))

    big = crowded(base, group, per_task)
    same = [] if big is None else [base[c].eqNullSafe(big[c]) for c in group]
    few = base if big is None else base.join(big, same, "left_anti")
    flows = _within(largest(few.repartition(*group)), group, key, threshold, top)  # the only shuffle: all windows and sums below are by group
    whole = Window.partitionBy(*group)
    flows = flows.withColumns({"criteria": F.sum("heads").over(whole), "tw": F.sum(F.col("heads") * F.col("weight")).over(whole)})
    out = flows.groupBy(*group, *item).agg(F.sum("leads").cast("long").alias("led"), F.sum(F.col("flow") * F.col("weight")).alias("wf"), F.first("criteria").alias("criteria"), F.first("tw").alias("tw"))
    number = F.row_number().over(whole.orderBy("__neg", *item)).cast("long")
    finish = lambda rows: rows.withColumn("flow", F.round(F.col("wf") / F.col("tw"), 6) + F.lit(0.0)).withColumn("__neg", -F.col("flow"))
    out = finish(out).withColumn("rank", number)
    columns = [*group, *item, "criteria", "led", "flow", "rank"]
    if big is None:
        return out.select(*columns)
    rows = checkpoint(largest(base.join(big, same, "left_semi")))
    many = _items(_spread(rows, key, threshold, top), group, item)
    totals = rows.groupBy(*key).agg(F.max("weight").alias("weight")).groupBy(*group).agg(F.count("*").alias("criteria"), F.sum("weight").alias("tw"))
    many = finish(many.join(totals, group))
    many = prefix_sums(many, group, ["__neg", *item], {"rank": F.lit(1)}).withColumn("rank", (F.col("rank") + 1).cast("long"))
    return out.select(*columns).unionByName(many.select(*columns))


def leaders_first(ranked: DataFrame, group: list[str], per_task: int = PER_TASK) -> DataFrame:
    """The ranking with the items that lead more than half of the group's criteria in front.

    Within both parts the order of the flow stands. This is a demand of the problem on top of
    the net flow, which alone does not guarantee it.
    """
    behind = ranked.withColumn("__behind", (F.col("led") * 2 <= F.col("criteria")).cast("int")).withColumnRenamed("rank", "__rank")
    return numbered(behind, group, ["__behind", "__rank"], "rank", per_task).drop("__behind", "__rank")


def criteria(hits: DataFrame, weights: DataFrame) -> DataFrame:
    """The rankings of each query: one per kind by ``score``, and one each by the body and graph
    values of the embed fields where the intent's field weight is above zero (weighted so)."""
    base = hits.select("query_id", "intent", "kind", "file_id", "line_start", "score", F.col("embed_fields.body").alias("body"), F.col("embed_fields.graph").alias("graph"))
    base = base.filter("query_id IS NOT NULL AND file_id IS NOT NULL AND line_start IS NOT NULL")
    w = weights.groupBy("intent").agg(F.max("body").alias("w_body"), F.max("graph").alias("w_graph"))  # one row an intent
    joined = base.join(F.broadcast(w), "intent", "left")
    cases = F.array(
        F.struct(F.col("kind").alias("criterion"), F.col("score").cast("double").alias("value"), F.lit(1.0).alias("weight")),
        F.struct(F.lit("field:body").alias("criterion"), F.col("body").cast("double").alias("value"), F.coalesce("w_body", F.lit(0.0)).cast("double").alias("weight")),
        F.struct(F.lit("field:graph").alias("criterion"), F.col("graph").cast("double").alias("value"), F.coalesce("w_graph", F.lit(0.0)).cast("double").alias("weight")),
    )
    return joined.select("query_id", "file_id", "line_start", F.inline(cases)).filter("criterion IS NOT NULL")


def p4_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The one order of every query's items."""
    long = criteria(table(spark, folder, "search_agent_hits"), table(spark, folder, "field_weights"))
    return leaders_first(net_flow(long, ["query_id"], ["file_id", "line_start"]), ["query_id"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The items that lead most rankings of their query: the first of the combined ranking.

    They are read off the ranking: as many of its first places as the query has such items.
    Ranks are compared in ranges of ``PER_TASK``, so a large query is not joined in one task.
    """
    ranked = checkpoint(p4_ranking(spark, folder))
    part = lambda c: F.floor((F.col(c) - 1) / PER_TASK)
    places = ranked.filter("led * 2 > criteria").groupBy("query_id").agg(F.count("*").alias("places"))
    places = places.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), part("places"))))
    first = ranked.withColumn("part", part("rank")).join(places, ["query_id", "part"]).filter("rank <= places")
    return first.select("query_id", "file_id", "line_start")


QUERIES = {"p4_found": p4_found, "p4_ranking": p4_ranking}
_CRITERIA = """
WITH w AS (SELECT intent, max(body) AS wb, max(graph) AS wg FROM field_weights GROUP BY intent),
b AS (SELECT h.*, w.wb, w.wg FROM search_agent_hits h LEFT JOIN w ON h.intent = w.intent),
c AS (
  SELECT query_id, file_id, line_start, kind AS criterion, score AS v, 1.0::DOUBLE AS wt FROM b
  UNION ALL SELECT query_id, file_id, line_start, 'field:body', embed_fields.body, wb FROM b WHERE wb > 0
  UNION ALL SELECT query_id, file_id, line_start, 'field:graph', embed_fields.graph, wg FROM b WHERE wg > 0),
d AS (SELECT query_id, file_id, line_start, criterion, max(v) AS v, max(wt) AS wt FROM c WHERE v IS NOT NULL AND isfinite(v) AND criterion IS NOT NULL AND query_id IS NOT NULL AND file_id IS NOT NULL AND line_start IS NOT NULL GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY query_id, criterion ORDER BY v DESC) AS k FROM d),
n AS (SELECT query_id, count(DISTINCT criterion) AS m FROM d GROUP BY query_id)"""
SQL = {
    "p4_found": _CRITERIA + """
SELECT query_id, file_id, line_start FROM r JOIN n USING (query_id)
GROUP BY query_id, file_id, line_start, m HAVING sum((k <= 3)::INT) * 2 > m""",
    # the definition: every item against every other on every criterion
    "p4_ranking": _CRITERIA + """,
p AS (SELECT *, count(*) OVER (PARTITION BY query_id, criterion) AS q, (rank() OVER (PARTITION BY query_id, criterion ORDER BY v) - 1 + (count(*) OVER (PARTITION BY query_id, criterion, v) - 1) / 2.0::DOUBLE) AS mid FROM r),
x AS (SELECT *, CASE WHEN q > 1 THEN mid / (q - 1) ELSE 0.5::DOUBLE END AS pct FROM p),
y AS (SELECT a.query_id, a.file_id, a.line_start, a.criterion, a.wt, a.k, CASE WHEN a.q > 1 THEN sum(least(greatest((a.pct - o.pct) / 0.25::DOUBLE, 0), 1) - least(greatest((o.pct - a.pct) / 0.25::DOUBLE, 0), 1)) / (a.q - 1) ELSE 0 END AS flow
  FROM x a JOIN x o ON a.query_id = o.query_id AND a.criterion = o.criterion GROUP BY a.query_id, a.file_id, a.line_start, a.criterion, a.wt, a.k, a.q),
t AS (SELECT query_id, sum(wt) AS tw FROM (SELECT query_id, criterion, max(wt) AS wt FROM d GROUP BY ALL) GROUP BY query_id),
z AS (SELECT query_id, file_id, line_start, m AS criteria, sum((k <= 3)::INT)::BIGINT AS led, round(sum(flow * wt) / max(tw), 6) + 0.0 AS flow FROM y JOIN n USING (query_id) JOIN t USING (query_id) GROUP BY query_id, file_id, line_start, m)
SELECT query_id, file_id, line_start, criteria, led, flow, row_number() OVER (PARTITION BY query_id ORDER BY (led * 2 <= criteria)::INT, -flow, file_id, line_start) AS rank FROM z""",
}
