"""Two channels joined by AND or AND NOT, by file or by span."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def and_file(left: DataFrame, right: DataFrame, negated: bool = False) -> DataFrame:
    return left.join(right.select("file").distinct(), "file", "left_anti" if negated else "left_semi")


BUCKET = 64


def within(left: DataFrame, right: DataFrame, negated: bool = False) -> DataFrame:
    """Left hits that hold a right hit within their lines or lie within one, or those that do not.

    On the first and last line of the wider span the narrower hit counts only if its symbol,
    caller or callee stands in the wider one's text, where it has one. Lines are cut into buckets, so a file's
    hits meet by bucket and not all with all.
    """
    words = lambda df: F.filter(F.array(*[F.col(c) for c in ("symbol", "caller", "callee") if c in df.columns]), lambda x: x.isNotNull())
    text_ = lambda df: F.col("excerpt") if "excerpt" in df.columns else F.lit(None).cast("string")
    cut = lambda c: (F.col(c) / BUCKET).cast("int")
    spread = lambda df, a, b, name: df.withColumn(name, F.explode(F.sequence(cut(a), cut(b))))
    key = ["file", "line_start", "line_end", "kind", "symbol"]
    l_ = spread(left.select(*key, words(left).alias("lw"), text_(left).alias("lt")).distinct(), "line_start", "line_end", "__b")
    r_ = spread(right.select(F.col("file").alias("rf"), F.col("line_start").alias("rs"), F.col("line_end").alias("re"), words(right).alias("rw"), text_(right).alias("rt")).distinct(), "rs", "re", "__rb")
    named = lambda t, w: t.isNull() | F.exists(w, lambda x: t.contains(x))
    s, e = F.col("line_start"), F.col("line_end")
    holds = (s <= F.col("rs")) & (F.col("re") <= e) & (((s < F.col("rs")) & (F.col("re") < e)) | named(F.col("lt"), F.col("rw")))
    lies = (F.col("rs") <= s) & (e <= F.col("re")) & (((F.col("rs") < s) & (e < F.col("re"))) | named(F.col("rt"), F.col("lw")))
    met = l_.join(r_, (F.col("file") == F.col("rf")) & (F.col("__b") == F.col("__rb")) & (holds | lies)).select(*[F.col(c).alias(f"__{c}") for c in key]).distinct()
    return left.join(met, [left[c].eqNullSafe(met[f"__{c}"]) for c in key], "left_anti" if negated else "left_semi")


def _spans(right: DataFrame) -> DataFrame:
    return right.select(F.col("file").alias("r_file"), F.col("line_start").alias("r_start"), F.col("line_end").alias("r_end"))


def and_span(left: DataFrame, right: DataFrame, negated: bool = False) -> DataFrame:
    """Left hits whose lines overlap a right hit of the same file (or none)."""
    on = (F.col("file") == F.col("r_file")) & (F.col("line_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("line_end"))
    return left.join(_spans(right), on, "left_anti" if negated else "left_semi")


def merge_evidence(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left hits with the contributors of overlapping right ones; a right hit goes to its first left hit only."""
    r = right.select(F.col("file").alias("r_file"), F.col("line_start").alias("r_start"), F.col("line_end").alias("r_end"), F.col("kind").alias("r_kind")).distinct()
    on = (F.col("file") == F.col("r_file")) & (F.col("line_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("line_end"))
    first = F.row_number().over(Window.partitionBy("r_file", "r_start", "r_end", "r_kind").orderBy("line_start", "line_end", "kind"))
    given = left.join(r, on).withColumn("n", first).filter("n = 1").groupBy("file", "line_start", "line_end", "kind").agg(F.collect_set("r_kind").alias("more"))
    out = left.join(given, ["file", "line_start", "line_end", "kind"], "left")
    return out.withColumn("contributors", F.array_sort(F.array_union("contributors", F.coalesce("more", F.array().cast("array<string>"))))).drop("more")
