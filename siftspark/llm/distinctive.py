"""Problem 2: how distinctive a term is per record.

Hypergeometric enrichment. A record holds ``n`` of the collection's ``N`` term
occurrences, a term has ``K`` of them, and ``k`` of those are in the record. The
score is ``-log10 P(X >= k)`` for X hypergeometric, exact to rounding: the first
probability by log-gamma, the rest of the tail by the ratio of neighbours. The
Benjamini-Hochberg adjustment gives the false-discovery rate.

Counting is one pre-aggregated shuffle by (record, term); totals of terms are a second
one. The join of counts with term totals is salted for the terms that very many
records hold, so no term, however common, goes to one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftspark.session import checkpoint
from siftspark.sources.tables import table

SALTS = 32
HOT_DF = 100_000  # a term in more records than this is salted
STEP = 0.01  # resolution of the score (log10 units) at which the discovery rate is ranked
_COEF = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)  # Stirling series, fixed values


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x >= 1, relative error below 1e-14."""
    x = np.asarray(x, np.float64).copy()
    shift = np.zeros_like(x)
    for _ in range(12):
        low = x < 12
        shift[low] += np.log(x[low])
        x[low] += 1
    inv = 1 / x
    tail = inv * (_COEF[0] + inv * inv * (_COEF[1] + inv * inv * (_COEF[2] + inv * inv * _COEF[3])))
    return (x - 0.5) * np.log(x) - x + 0.9189385332046728 + tail - shift


def log10_upper_tail(k, n, big_k, big_n) -> np.ndarray:
    """log10 P(X >= k), X the number of marked among ``n`` drawn of ``big_n`` with ``big_k`` marked."""
    k, n, big_k, big_n = (np.asarray(v, np.float64) for v in (k, n, big_k, big_n))
    top = np.minimum(n, big_k)
    choose = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    start = np.maximum(k, np.maximum(0, n + big_k - big_n))
    with np.errstate(all="ignore"):
        first = choose(big_k, start) + choose(big_n - big_k, n - start) - choose(big_n, n)
        total, term, i = np.ones(len(k)), np.ones(len(k)), start.copy()
        live = np.flatnonzero(i < top)
        while len(live):
            j = i[live]
            term[live] *= (big_k[live] - j) * (n[live] - j) / ((j + 1) * (big_n[live] - big_k[live] - n[live] + j + 1))
            total[live] += term[live]
            i[live] = j + 1
            past = i[live] > n[live] * big_k[live] / big_n[live]  # beyond the mean the terms only fall
            live = live[(i[live] < top[live]) & ~(past & (term[live] < 1e-17 * total[live]))]
        out = (first + np.log(total)) / np.log(10)
    out = np.where(start <= np.maximum(0, n + big_k - big_n), 0.0, out)
    return np.where(k > top, -np.inf, np.minimum(out, 0.0))


@F.pandas_udf(T.DoubleType())
def _score(k: pd.Series, n: pd.Series, big_k: pd.Series, big_n: pd.Series) -> pd.Series:
    return pd.Series(-log10_upper_tail(k.values, n.values, big_k.values, big_n.values) + 0.0)


def enrichment(counts: DataFrame, min_df: int = 1, max_df: int | None = None) -> DataFrame:
    """Score every term of every record.

    ``counts`` has ``record, term, tf`` with one row per pair. All of its rows make up the
    totals ``n``, ``K`` and ``N``; scored are the terms that at least ``min_df`` and at most
    ``max_df`` records hold. Returns ``record, term, tf, df, score, fdr``; ``fdr`` is ranked
    over the scored pairs at a resolution of 0.01 score units, rounded to the side of the
    larger rate. Null records or terms and counts below one are left out. An empty table
    gives an empty result; extra columns are ignored.
    """
    counts = checkpoint(counts.select("record", "term", F.col("tf").cast("long").alias("tf")).filter("record IS NOT NULL AND term IS NOT NULL AND tf > 0"))
    sizes = counts.groupBy("record").agg(F.sum("tf").alias("n"))
    terms = counts.groupBy("term").agg(F.sum("tf").alias("K"), F.count("*").alias("df"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("N")).first()["N"]
    kept = terms.filter(F.col("df") >= min_df)
    if max_df is not None:
        kept = kept.filter(F.col("df") <= max_df)
    if max_df is not None and max_df <= HOT_DF:
        pairs = counts.join(kept, "term")
    else:  # the totals of hot terms are copied to every salt, their rows are spread over the salts
        hot = F.col("df") > HOT_DF
        copies = kept.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
        names = kept.filter(hot).select(F.col("term").alias("hot_term"))  # at most rows / HOT_DF terms
        marked = counts.join(F.broadcast(names), counts.term == names.hot_term, "left")  # a shuffle by term would undo the salting
        salted = marked.withColumn("salt", F.when(F.col("hot_term").isNotNull(), F.pmod(F.xxhash64("record"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot_term")
        pairs = salted.join(copies, ["term", "salt"]).drop("salt")
    scored = pairs.join(sizes, "record").withColumn("score", _score("tf", "n", "K", F.lit(total)))
    scored = scored.withColumn("step", F.least(F.floor(F.col("score") / STEP), F.lit(100_000)).cast("int"))
    scored = checkpoint(scored.select("record", "term", "tf", "df", "score", "step"))
    steps = scored.groupBy("step").count().orderBy(F.desc("step")).collect()  # at most 100,001 rows
    m, seen, rates = sum(r["count"] for r in steps), 0, []
    for r in steps:
        seen += r["count"]
        rates.append([r["step"], min(1.0, 10 ** (-r["step"] * STEP) * m / seen)])
    for a, b in zip(reversed(rates[:-1]), reversed(rates[1:])):
        a[1] = min(a[1], b[1])
    fdr = scored.sparkSession.createDataFrame(rates or [[-1, 1.0]], "step int, fdr double")
    return scored.join(F.broadcast(fdr), "step").drop("step")


def content_counts(lines: DataFrame, min_len: int = 5) -> DataFrame:
    """``record, term, tf`` of the words (ASCII letters, lower case) of each file's lines.

    A line delivered twice counts once; null contents count nothing.
    """
    once = lines.filter("file_id IS NOT NULL AND content IS NOT NULL").groupBy("file_id", "line_no").agg(F.first("content").alias("content"))
    word = F.explode(F.regexp_extract_all("content", F.lit(f"[A-Za-z]{{{min_len},}}"), 0))
    return once.select("file_id", word.alias("term")).groupBy(F.col("file_id").alias("record"), F.lower("term").alias("term")).agg(F.count("*").alias("tf"))


def name_counts(symbols: DataFrame) -> DataFrame:
    """``record, term, tf`` of the names of each file's symbols; a symbol delivered twice counts once."""
    once = symbols.filter("file_id IS NOT NULL AND name IS NOT NULL").select("symbol_id", "file_id", F.lower("name").alias("term")).distinct()
    return once.groupBy(F.col("file_id").alias("record"), "term").agg(F.count("*").alias("tf"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of two to six files that one of these repeats."""
    content = enrichment(content_counts(table(spark, folder, "source_lines")), 2, 6).filter("tf >= 4")
    names = enrichment(name_counts(table(spark, folder, "symbols")), 2, 6).filter("tf >= 2")
    both = content.withColumn("field", F.lit("content")).unionByName(names.withColumn("field", F.lit("name")))
    return both.select("field", F.col("record").alias("file_id"), "term")


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of every file with its score and false-discovery rate (to three places)."""
    scored = enrichment(content_counts(table(spark, folder, "source_lines")))
    return scored.select(F.col("record").alias("file_id"), "term", "tf", "df", F.round("score", 3).alias("score"), F.round("fdr", 3).alias("fdr"))


QUERIES = {"p2_found": p2_found, "p2_scores": p2_scores}
SQL = {
    # the definition: the sum of all probabilities of the tail, each by log-gamma
    "p2_scores": """
WITH l AS (SELECT DISTINCT file_id, line_no, content FROM source_lines),
w AS (SELECT file_id, lower(t) AS term FROM (SELECT file_id, unnest(regexp_extract_all(content, '[A-Za-z]{5,}')) AS t FROM l)),
c AS (SELECT file_id, term, count(*) AS tf FROM w GROUP BY file_id, term),
b AS (SELECT *, sum(tf) OVER (PARTITION BY file_id)::DOUBLE AS n, sum(tf) OVER (PARTITION BY term)::DOUBLE AS bk, count(*) OVER (PARTITION BY term) AS df, sum(tf) OVER ()::DOUBLE AS bn FROM c),
i AS (SELECT *, unnest(range(tf, least(n, bk)::BIGINT + 1)) AS i FROM b),
q AS (SELECT file_id, term, tf, df, n, bk, bn, lgamma(bk + 1) - lgamma(i + 1) - lgamma(bk - i + 1) + lgamma(bn - bk + 1) - lgamma(n - i + 1) - lgamma(bn - bk - n + i + 1) - lgamma(bn + 1) + lgamma(n + 1) + lgamma(bn - n + 1) AS lp
  FROM i WHERE bn - bk - n + i + 1 > 0),
s AS (SELECT file_id, term, tf, df, greatest(0, -(max(m) + ln(sum(exp(lp - m)))) / ln(10)) AS score FROM (SELECT *, max(lp) OVER (PARTITION BY file_id, term) AS m FROM q) GROUP BY file_id, term, tf, df),
t AS (SELECT step, count(*) AS k FROM (SELECT least(floor(score / 0.01), 100000)::INT AS step FROM s) GROUP BY step),
r AS (SELECT step, least(1.0::DOUBLE, pow(10, -step * 0.01::DOUBLE) * sum(k) OVER () / sum(k) OVER (ORDER BY step DESC)) AS rate FROM t),
f AS (SELECT step, min(rate) OVER (ORDER BY step) AS fdr FROM r)
SELECT file_id, term, tf, df, round(score, 3) + 0.0 AS score, round(fdr, 3) AS fdr FROM s JOIN f ON f.step = least(floor(score / 0.01), 100000)::INT""",
    "p2_found": """
WITH l AS (SELECT DISTINCT file_id, line_no, content FROM source_lines),
w AS (SELECT file_id, lower(t) AS term FROM (SELECT file_id, unnest(regexp_extract_all(content, '[A-Za-z]{5,}')) AS t FROM l)),
c AS (SELECT 'content' AS field, file_id, term, count(*) AS tf, 4 AS least FROM w GROUP BY file_id, term),
n AS (SELECT 'name' AS field, file_id, lower(name) AS term, count(DISTINCT symbol_id) AS tf, 2 AS least FROM symbols GROUP BY file_id, lower(name)),
b AS (SELECT *, count(*) OVER (PARTITION BY field, term) AS df FROM (SELECT * FROM c UNION ALL SELECT * FROM n))
SELECT field, file_id, term FROM b WHERE df BETWEEN 2 AND 6 AND tf >= least""",
}
