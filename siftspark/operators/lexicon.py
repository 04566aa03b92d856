"""Term associations: which terms occur together more than chance, and query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUPPORT, PER_TERM, EXPANSIONS = 3, 8, 5
IDENTIFIER_TERMS, PROSE_TERMS = 8, 64


# Words too common in names and prose to tell anything (fixed values).
STOP_TERMS = ("the", "and", "for", "with", "from", "this", "that", "into", "are", "was", "not", "has", "its", "get", "set")


def subtokens(c: Column) -> Column:
    """Distinct lower-case parts (3 to 64 characters) at marks and changes of case."""
    parts = F.split(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " "), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.lower(x)), lambda x: F.length(x).between(3, 64)))


def observations(chunks: DataFrame, name: str = "symbol_name", prose: str = "doc") -> DataFrame:
    """``key, identifier, context``: a definition's name parts and the terms of its documentation."""
    stop = F.array(*[F.lit(t) for t in STOP_TERMS])  # the first terms in the order of the text, without stop terms
    ident = F.slice(F.array_except(subtokens(F.col(name)), stop), 1, IDENTIFIER_TERMS)
    words = F.slice(F.array_except(subtokens(F.coalesce(prose, F.lit(""))), stop), 1, PROSE_TERMS)
    rows = chunks.select(F.col("chunk_id").alias("key"), ident.alias("identifier"), words.alias("prose"))
    rows = rows.withColumn("context", F.array_distinct(F.concat("identifier", "prose"))).filter("size(identifier) > 0 AND size(context) >= 2")
    return rows.select("key", "identifier", "context")


def ppmi(observed: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``term, related, ppmi, support`` of pairs seen at least ``support`` times."""
    pairs = observed.select(F.explode("identifier").alias("term"), "context").select("term", F.explode("context").alias("related")).filter("term <> related")
    counts = pairs.groupBy("term", "related").agg(F.count("*").alias("support"))
    left = counts.groupBy("term").agg(F.sum("support").alias("n_term"))
    right = counts.groupBy("related").agg(F.sum("support").alias("n_related"))
    total = counts.agg(F.sum("support").alias("n"))
    rows = counts.filter(F.col("support") >= support).join(left, "term").join(right, "related").crossJoin(F.broadcast(total))
    pmi = F.log(F.col("support") * F.col("n") / (F.col("n_term") * F.col("n_related")))
    return rows.select("term", "related", F.round(pmi, 6).alias("ppmi"), "support").filter("ppmi > 0")


def top(associations: DataFrame, k: int = PER_TERM) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("ppmi"), F.desc("support"), "related"))
    return associations.withColumn("r", nth).filter(F.col("r") <= k).drop("r")


def expand(associations: DataFrame, terms: list[str], k: int = EXPANSIONS) -> DataFrame:
    """Up to five terms related to the query's, in either direction."""
    both = associations.select("term", "related", "ppmi").unionByName(associations.select(F.col("related").alias("term"), F.col("term").alias("related"), "ppmi"))
    found = both.filter(F.col("term").isin(terms) & ~F.col("related").isin(terms)).groupBy("related").agg(F.max("ppmi").alias("ppmi"))
    return found.orderBy(F.desc("ppmi"), "related").limit(k)
