"""Fusing channels: dedup, weighted reciprocal ranks, critic, margins, confidence, final order.

All functions take hits of one or more queries; ``keys`` names the columns that tell
queries apart, so many queries are fused in one job. Ranks are windows over one query's
channel pool, which the channels bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Channel names and their order (fixed values).
CHANNELS = ("asgrep", "def", "caller", "graph", "anchor", "import", "pattern", "embed")
KIND_ORDER = ("def", "caller", "graph", "pattern", "import", "anchor", "asgrep", "embed")
# Channel weights by intent (fixed values); other intents weigh all channels 1.
WEIGHTS = {
    "conceptual": {"asgrep": 1.1, "def": 0.9, "caller": 0.8, "graph": 0.7, "anchor": 0.8, "embed": 1.1, "pattern": 0.25, "import": 0.8},
    "symbol": {"asgrep": 1.0, "def": 2.0, "caller": 1.15, "graph": 0.9, "anchor": 1.0, "embed": 0.8, "pattern": 0.25, "import": 1.0},
}
AGREE, STRONG, COLLISION = 1.15, 1.25, 0.85


def signal(kind: Column) -> Column:
    return F.when(kind == "asgrep", "exact").when(kind == "embed", "semantic").otherwise("structural")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def weight(intent: Column, kind: Column) -> Column:
    out = F.lit(1.0)
    for name, table in WEIGHTS.items():
        for channel, w in table.items():
            out = F.when((intent == name) & (kind == channel), F.lit(w)).otherwise(out)
    return out


def priority(kind: Column) -> Column:
    out = F.lit(len(KIND_ORDER))
    for i, k in enumerate(KIND_ORDER):
        out = F.when(kind == k, F.lit(i)).otherwise(out)
    return out


def union(*channels: DataFrame) -> DataFrame:
    out = channels[0]
    for c in channels[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def dedup(hits: DataFrame, keys: list[str], edge: list[str] | None = None) -> DataFrame:
    """One hit per place and symbol: the best score gives the row, contributors and nulls are filled in.

    ``edge`` names further columns of the key (caller and callee, where hits have them).
    """
    place = [*keys, "file", "line_start", "line_end", "symbol", *(edge or [])]
    score = F.when(finite(F.col("score")), F.col("score")).otherwise(F.lit(float("-inf")))
    rank = F.struct(score.alias("s"), (-priority(F.col("kind"))).alias("p"), F.col("kind").alias("k"))
    strength = F.when(F.col("signal") == "exact", 2).when(F.col("signal") == "structural", 1).otherwise(0)
    out = hits.groupBy(*place).agg(
        F.max(rank).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("contributors", F.array(F.col("kind"))))))).alias("contributors"),
        F.max(strength).alias("st"), F.max("language").alias("language"), F.count("*").alias("merged"),
    )
    name = F.when(F.col("st") == 2, "exact").when(F.col("st") == 1, "structural").otherwise("semantic")
    return out.select(*place, F.col("r.k").alias("kind"), F.when(F.col("r.s") > float("-inf"), F.col("r.s")).alias("score"), name.alias("signal"), "contributors", "language", "merged")


def weighted_rrf(hits: DataFrame, keys: list[str]) -> DataFrame:
    """``<keys>, file, line_start, score, kind, contributors``: sum of weight / (61 + rank) over the channels.

    Within a channel only an item's best row takes a rank; the row of the first kind in
    priority stands for the item. Rows without a finite score have no rank.
    """
    item = [*keys, "file", "line_start"]
    good = hits.filter(finite(F.col("score")))
    best = good.groupBy(*item, "kind").agg(F.max("score").alias("score"), F.min("line_end").alias("line_end"), F.max("intent").alias("intent"), F.max("symbol").alias("symbol"))
    order = Window.partitionBy(*keys, "kind").orderBy(F.desc("score"), "file", "line_start", "line_end")
    ranked = best.withColumn("rank", F.row_number().over(order) - 1)
    share = weight(F.col("intent"), F.col("kind")) / (F.lit(61.0) + F.col("rank"))
    head = F.min(F.struct(priority(F.col("kind")).alias("p"), (-F.col("score")).alias("n"), "line_end", "kind"))
    out = ranked.groupBy(*item).agg(F.round(F.sum(share), 9).alias("score"), head.alias("h"), F.array_sort(F.collect_set("kind")).alias("contributors"), F.max("symbol").alias("symbol"), F.max("intent").alias("intent"))
    return out.select(*item, "score", F.col("h.kind").alias("kind"), F.col("h.line_end").alias("line_end"), "symbol", "intent", "contributors")


def critic(fused: DataFrame) -> DataFrame:
    """Agreement raises a score; evidence of the embedding alone is noted, not dropped."""
    has = lambda *kinds: F.arrays_overlap("contributors", F.array(*[F.lit(k) for k in kinds]))
    semantic, usage, definition = has("embed"), has("caller", "graph"), has("def")
    structural = has("def", "caller", "graph", "anchor", "import", "pattern")
    factor = F.when(semantic & usage & definition, STRONG).when(semantic & structural, AGREE).otherwise(F.lit(1.0))
    note = F.when(semantic & usage & definition, "definition_usage_semantic").when(semantic & structural, "semantic_structural").when(semantic & (F.size("contributors") == 1), "uncorroborated_semantic")
    return fused.withColumn("critic", note).withColumn("score", F.round(F.col("score") * factor, 9))


def witnessed(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Embedding hits that no other channel supports by span or symbol in the same file."""
    embed = hits.filter("kind = 'embed'").select(*keys, "file", "line_start", "line_end", "symbol").distinct()
    other = hits.filter("kind <> 'embed'").select(*[F.col(k).alias(f"w_{k}") for k in keys], F.col("file").alias("w_file"), F.col("line_start").alias("w_s"), F.col("line_end").alias("w_e"), F.col("symbol").alias("w_sym"))
    on = [F.col(k) == F.col(f"w_{k}") for k in keys] + [F.col("file") == F.col("w_file")]
    near = ((F.col("line_start") <= F.col("w_e")) & (F.col("w_s") <= F.col("line_end"))) | (F.col("symbol") == F.col("w_sym"))
    return embed.join(other, [*on, near], "left_anti")


def collision(fused: DataFrame, excerpt: str, identifier: str) -> DataFrame:
    """A hit on a fragment of ``identifier`` that does not hold all of it counts less."""
    missing = ~F.col(excerpt).contains(identifier)
    return fused.withColumn("score", F.when(missing, F.round(F.col("score") * COLLISION, 9)).otherwise(F.col("score")))


def margins(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The gap of each score to the next lower one of the same signal; ties and the last have none."""
    group = [*keys, "signal"]
    levels = hits.filter(finite(F.col("score"))).groupBy(*group, "score").agg(F.count("*").alias("ties"))
    gap = F.col("score") - F.lead("score").over(Window.partitionBy(*group).orderBy(F.desc("score")))
    levels = levels.withColumn("margin", F.when((F.col("ties") == 1) & gap.isNotNull(), F.round(gap, 9)).otherwise(0.0)).drop("ties")
    return hits.drop("margin").join(levels, [*group, "score"], "left")


def confidence(signal_: Column, contributors: Column) -> Column:
    base = F.when(signal_ == "exact", 0.75).when(signal_ == "structural", 0.60).otherwise(0.35)
    return F.round(F.least(F.lit(0.99), base + 0.08 * F.least(F.greatest(F.size(contributors) - 1, F.lit(0)), F.lit(3))), 6)


def per_file_cap(hits: DataFrame, keys: list[str], keep: int = 3) -> DataFrame:
    """Final position: the first three of a file stand in order, its others after all files."""
    order = [F.desc("score"), F.asc("file"), F.asc("line_start")]
    nth = hits.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "file").orderBy(*order)))
    late = (F.col("nth") > keep).cast("int")
    return nth.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(late, *order))).drop("nth")


def promote_definition(ordered: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """If no definition is among the first ``limit`` but one exists, the best takes the last place."""
    w = Window.partitionBy(*keys)
    head = F.max(((F.col("kind") == "def") & (F.col("position") <= limit)).cast("int")).over(w)
    best = F.min(F.when(F.col("kind") == "def", F.col("position"))).over(w)
    moved = ordered.withColumn("__h", head).withColumn("__b", best)
    take = (F.col("__h") == 0) & (F.col("position") == F.col("__b"))
    shift = (F.col("__h") == 0) & F.col("__b").isNotNull() & F.col("position").between(F.lit(limit), F.col("__b") - 1)
    place = F.when(take, F.lit(limit)).when(shift, F.col("position") + 1).otherwise(F.col("position"))
    return moved.withColumn("position", place).drop("__h", "__b")


def normalise(score: Column, kind: Column, terms: int) -> Column:
    """A channel's score over its ceiling, within 0 and 1 (fixed ceilings)."""
    m = max(terms, 1)
    ceiling = {"asgrep": 200 / 61, "def": 10 * m + 3.0, "caller": 10 * m + 1.5, "graph": 5.0, "anchor": 6.0, "embed": 4.0, "pattern": 7.0, "import": 2.0}
    out = F.lit(0.0)
    for k, c in ceiling.items():
        out = F.when(kind == k, score / c).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))
