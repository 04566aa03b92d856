"""Measures of retrieval: reciprocal rank, gain, recall, precision by tier, reads saved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.operators.symbols import PRECISION


def ranking(ranked: DataFrame, gold: DataFrame, keys: list[str], item: list[str], cuts: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Per query: ``mrr``, ``ndcg`` and recall at each cut; ``ranked`` has ``position`` from 1."""
    want = gold.select(*keys, *item).distinct()
    n = want.groupBy(*keys).agg(F.count("*").alias("n"))
    found = ranked.join(want, [*keys, *item]).groupBy(*keys, *item).agg(F.min("position").alias("position"))
    gain = F.sum(1.0 / F.log2(F.col("position") + 1.0))
    per = found.groupBy(*keys).agg(F.min("position").alias("first"), gain.alias("dcg"), *[F.sum((F.col("position") <= c).cast("int")).alias(f"r{c}") for c in cuts])
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    out = n.join(per, keys, "left")
    return out.select(*keys, F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"), *[F.round(F.coalesce(F.col(f"r{c}") / F.col("n"), F.lit(0.0)), 6).alias(f"recall_{c}") for c in cuts])


def greedy(ranked: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """``<keys>, gold_id, position``: hits in order each take the first free gold entry they match.

    ``ranked`` has ``position, file, symbol``; ``gold`` has ``gold_id, file, symbol`` (a null symbol
    matches any). One hit takes one entry, one entry is taken once. A query's judged entries are
    few, so a query is one unit of work.
    """
    import pandas as pd

    pairs = ranked.select(*keys, "position", F.col("file").alias("rf"), F.col("symbol").alias("rs")).join(gold.select(*keys, "gold_id", F.col("file").alias("gf"), F.col("symbol").alias("gs")), keys)
    pairs = pairs.filter((F.col("rf") == F.col("gf")) & (F.col("gs").isNull() | F.col("gs").eqNullSafe(F.col("rs")))).select(*keys, "gold_id", "position")
    kinds = ", ".join(f"{k} {ranked.schema[k].dataType.simpleString()}" for k in keys)

    def take(f: pd.DataFrame) -> pd.DataFrame:
        hits, entries, out = set(), set(), []
        for r in f.sort_values(["position", "gold_id"]).itertuples(index=False):
            if r.position not in hits and r.gold_id not in entries:
                hits.add(r.position)
                entries.add(r.gold_id)
                out.append(r)
        return pd.DataFrame(out, columns=f.columns)

    return pairs.groupBy(*keys).applyInPandas(take, f"{kinds}, gold_id {gold.schema['gold_id'].dataType.simpleString()}, position {ranked.schema['position'].dataType.simpleString()}")


def timings(runs: DataFrame, by: str = "query", value: str = "seconds") -> DataFrame:
    """Per query: mean, geometric mean, variation, median and upper percentiles of its runs."""
    v = F.col(value)
    return runs.filter(v > 0).groupBy(by).agg(F.count("*").alias("runs"), F.avg(v).alias("mean"), F.exp(F.avg(F.log(v))).alias("geomean"), (F.coalesce(F.stddev_samp(v), F.lit(0.0)) / F.avg(v) * 100).alias("cv_pct"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile({value}, 0.95)").alias("p95"), F.expr(f"percentile({value}, 0.99)").alias("p99"))


def tier_precision(edges: DataFrame, gold: DataFrame) -> DataFrame:
    """Per tier the share of distinct edges that the gold holds; an edge counts at its best tier."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PRECISION]), F.col("resolution"))
    best = edges.groupBy("path", "caller", "callee").agg(F.min(F.struct(rank.alias("r"), "resolution")).alias("b")).select("path", "caller", "callee", F.col("b.resolution").alias("resolution"))
    held = best.join(gold.select("path", "caller", "callee", F.lit(1).alias("ok")).distinct(), ["path", "caller", "callee"], "left")
    return held.groupBy("resolution").agg(F.count("*").alias("edges"), F.round(F.avg(F.coalesce("ok", F.lit(0))), 3).alias("precision"))


def prevented_reads(hits: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Per query: bytes of the distinct files hit, less the bytes of the excerpts shown, not below zero."""
    files = hits.select(*keys, "file").distinct().join(sizes, "file").groupBy(*keys).agg(F.sum("bytes").alias("all"))
    shown = hits.groupBy(*keys).agg(F.sum(F.coalesce(F.octet_length("excerpt"), F.lit(0))).alias("shown"))
    return files.join(shown, keys).select(*keys, F.greatest(F.col("all") - F.col("shown"), F.lit(0)).cast("long").alias("prevented"))


def pairwise_loss(weights: dict[str, float], judged: list[tuple[dict[str, int], dict[str, int]]], scale: float = 100.0) -> float:
    """Mean logistic loss of judged pairs ``(better, worse)``, each the rank of an item by channel."""
    from math import exp, log1p

    score = lambda ranks: sum(weights.get(c, 1.0) / (61.0 + r) for c, r in ranks.items())
    total = 0.0
    for better, worse in judged:
        d = scale * (score(better) - score(worse))
        total += log1p(exp(-d)) if d > -30 else -d
    return total / max(1, len(judged))


def sensitivity(weights: dict[str, float], judged: list, step: float = 0.05) -> dict[str, tuple[float, float]]:
    """Gradient and curvature of the loss by channel."""
    at = pairwise_loss(weights, judged)
    out = {}
    for c in weights:
        up, down = (pairwise_loss(weights | {c: weights[c] + s}, judged) for s in (step, -step))
        out[c] = ((up - down) / (2 * step), (up - 2 * at + down) / step**2)
    return out


def churn(weights: dict[str, float], ranked: list[dict[str, int]], channel: str, step: float = 0.05) -> int:
    """How many items change their place if a channel's weight moves by ``step``; items are ranks by channel."""
    score = lambda w, r: sum(w.get(c, 1.0) / (61.0 + k) for c, k in r.items())
    order = lambda w: sorted(range(len(ranked)), key=lambda i: (-score(w, ranked[i]), i))
    return sum(a != b for a, b in zip(order(weights), order(weights | {channel: weights.get(channel, 1.0) + step})))


def learn_weights(weights: dict[str, float], judged: list, rounds: int = 64, step: float = 0.25, least: float = 1e-3) -> dict[str, float]:
    """Coordinate search over the channels whose curvature matters, within 0.25 and 2."""
    curve = sensitivity(weights, judged)
    top = max((abs(c) for _, c in curve.values()), default=0.0)
    stiff = [c for c, (_, k) in curve.items() if top and abs(k) >= 0.1 * top]
    best, loss = dict(weights), pairwise_loss(weights, judged)
    for _ in range(rounds):
        better = False
        for c in stiff:
            for s in (step, -step):
                trial = best | {c: min(2.0, max(0.25, best[c] + s))}
                if (now := pairwise_loss(trial, judged)) < loss - 1e-12:
                    best, loss, better = trial, now, True
        if not better:
            step /= 2
            if step < least:
                break
    return best
