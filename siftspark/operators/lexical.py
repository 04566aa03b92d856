"""Ranked lexical search: two analyzers, postings, BM25 and rank fusion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

K1, B = 1.2, 0.75
SCALE, RRF_K = 200.0, 60


def code_terms(content: Column) -> Column:
    """Unstemmed terms; an underscore is part of a term."""
    return F.regexp_extract_all(F.lower(content), F.lit(r"[\p{L}\p{N}_]+"), 0)


def prose_terms(content: Column) -> Column:
    """Terms of prose, folded and stemmed (see ``porter``)."""
    return F.regexp_extract_all(F.lower(content), F.lit(r"[\p{L}\p{N}]+"), 0)


def _collapse(shape: str) -> str:
    out = ""
    for c in shape:
        if not out or out[-1] != c:
            out += c
    return out


def stem(w: str) -> str:
    """Porter's stemmer."""
    if len(w) <= 2 or not w.isascii() or not w.isalpha():
        return w
    vowel = lambda s: any(c in "aeiou" or (c == "y" and i and s[i - 1] not in "aeiou") for i, c in enumerate(s))
    m = lambda s: _collapse("".join("v" if c in "aeiou" or (c == "y" and i and s[i - 1] not in "aeiou") else "c" for i, c in enumerate(s))).count("vc")
    cvc = lambda s: len(s) > 2 and s[-1] not in "aeiouwxy" and s[-2] in "aeiouy" and s[-3] not in "aeiou"
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    elif w.endswith("ed") and vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
            w = w[:-1]
        elif m(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in _STEPS[:2]:
        for old, new in table:
            if w.endswith(old):
                if m(w[: -len(old)]) > 0:
                    w = w[: -len(old)] + new
                break
    for old in _STEPS[2]:
        if w.endswith(old):
            base = w[: -len(old)]
            if m(base) > 1 and (old != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and m(w[:-1]) > 1:
        w = w[:-1]
    return w


# Suffixes of Porter's steps 2 to 4, longest first where one ends another (fixed values).
_STEPS = (
    (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")),
    (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")),
    ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"),
)


@F.pandas_udf(T.StringType())
def porter(terms: pd.Series) -> pd.Series:
    known = {t: stem(t) for t in terms.dropna().unique()}
    return terms.map(known)


def postings(lines: DataFrame, analyzer=code_terms) -> DataFrame:
    """``term, path, line_no, tf, dl``: the inverted index; dl is the line's number of terms.

    A line is one row, so its terms are counted within it (sorted, the length of each run) and
    given out once: no shuffle.
    """
    rows = lines.select("path", "line_no", F.array_sort(analyzer(F.col("content"))).alias("t")).withColumn("dl", F.size("t"))
    firsts = F.filter(F.sequence(F.lit(1), F.col("dl")), lambda i: (i == 1) | (F.element_at("t", i) != F.element_at("t", F.greatest(i - 1, F.lit(1)))))
    rows = rows.filter("dl > 0").withColumn("at", firsts)
    ends = F.concat(F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))), F.array(F.col("dl") + 1))
    runs = F.zip_with("at", ends, lambda a, b: F.struct(F.element_at(F.col("t"), a).alias("term"), (b - a).cast("long").alias("tf")))
    return rows.select("path", "line_no", "dl", F.inline(runs)).select("term", "path", "line_no", "dl", "tf")


def statistics(lines: DataFrame, analyzer=code_terms) -> DataFrame:
    """One row ``n, avgdl``: the number of lines and their mean number of terms."""
    return lines.select(F.size(analyzer(F.col("content"))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25_indexed(index: DataFrame, stats: DataFrame, terms: list[str], limit: int = 100) -> DataFrame:
    """``bm25`` from published postings and statistics: only the query's terms are read, no text."""
    match = index.filter(F.col("term").isin(*sorted(set(terms))))
    return _best(match, stats, limit)


def bm25(lines: DataFrame, terms: list[str], limit: int = 100, analyzer=code_terms) -> DataFrame:
    """The ``limit`` best lines for any of the terms, ties by (path, line).

    Only lines with a query term are exploded; the collection's statistics are one aggregate.
    """
    all_terms = analyzer(F.col("content"))
    query = F.array(*[F.lit(t) for t in sorted(set(terms))])
    sized = lines.select("path", "line_no", all_terms.alias("t")).select("path", "line_no", F.size("t").alias("dl"), F.filter("t", lambda x: F.array_contains(query, x)).alias("q"))
    stats = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    match = sized.filter(F.size("q") > 0).select("path", "line_no", "dl", F.explode("q").alias("term")).groupBy("path", "line_no", "dl", "term").agg(F.count("*").alias("tf"))
    return _best(match, stats, limit)


def _best(match: DataFrame, stats: DataFrame, limit: int) -> DataFrame:
    df = match.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = match.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("path", "line_no").agg(F.round(F.sum(idf * tf), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "path", "line_no").limit(limit)


def rrf(rank: Column, k: int = RRF_K) -> Column:
    """Reciprocal-rank score of a rank from 0."""
    return F.lit(1.0) / (F.lit(float(k + 1)) + rank)


def ranked(best: DataFrame) -> DataFrame:
    """Rank from 0 of at most a pool of rows."""
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "path", "line_no")) - 1)


def lexical(lines: DataFrame, terms: list[str], pool: int = 100) -> DataFrame:
    """The code analyzer first; the prose analyzer joins in if the pool is not full.

    A line that both find adds up both reciprocal ranks.
    """
    first = ranked(bm25(lines, terms, pool))
    short = F.lit(first.count() < pool)
    second = ranked(bm25(lines, terms, pool, prose_terms)).filter(short)
    both = first.unionByName(second)
    return both.groupBy("path", "line_no").agg(F.round(F.sum(rrf(F.col("rank"))) * SCALE, 6).alias("score")).orderBy(F.desc("score"), "path", "line_no").limit(pool)
