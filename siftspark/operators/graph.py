"""The call graph: neighbours, chains of files, shortest call paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.session import checkpoint
from siftspark.sources.facts import ascii_lower

DEPTH, DECAY, NODES, DEFS = 2, 0.5, 100, 8
PATH_DEPTH, PATH_NODES = 8, 10_000


def incoming(calls: DataFrame, name: str) -> DataFrame:
    return calls.filter(ascii_lower(F.col("callee")) == ascii_lower(F.lit(name))).select("path", "line_no", "caller", "callee")


def outgoing(calls: DataFrame, name: str) -> DataFrame:
    return calls.filter(ascii_lower(F.col("caller")) == ascii_lower(F.lit(name))).select("path", "line_no", "caller", "callee")


def file_edges(calls: DataFrame, symbols: DataFrame, most: int = DEFS, imports: DataFrame | None = None) -> DataFrame:
    """File to file by call: a callee's first ``most`` definitions are its targets; and by resolved import (``path, target``)."""
    nth = F.row_number().over(Window.partitionBy("low").orderBy("path", "byte_start"))
    defs = symbols.select(ascii_lower(F.col("name")).alias("low"), "path", "byte_start").withColumn("r", nth).filter(F.col("r") <= most).select("low", F.col("path").alias("target"))
    rows = calls.select(F.col("path").alias("source"), ascii_lower(F.col("callee")).alias("low")).distinct()
    edges = rows.join(defs, "low").filter("source <> target").select("source", "target")
    if imports is not None:
        edges = edges.unionByName(imports.select(F.col("path").alias("source"), "target").filter("source <> target"))
    return edges.distinct()


def chain(seeds: DataFrame, edges: DataFrame, depth: int = DEPTH, most: int = NODES) -> DataFrame:
    """``file, score, hop``: files around the seeds along calls both ways; the score halves per hop.

    One join per hop against the new files only; a file keeps its best score at its first hop.
    """
    both = edges.select(F.col("source").alias("from"), F.col("target").alias("file")).unionByName(edges.select(F.col("target").alias("from"), F.col("source").alias("file"))).distinct()
    seen = checkpoint(seeds.groupBy("file").agg(F.max("score").alias("score")).withColumn("hop", F.lit(0)))
    new = seen
    for hop in range(1, depth + 1):
        step = both.join(new.select(F.col("file").alias("from"), "score"), "from").groupBy("file").agg((F.max("score") * DECAY).alias("score"))
        new = checkpoint(step.join(seen.select("file"), "file", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(new)
    return seen.orderBy(F.desc("score"), "hop", "file").limit(most)


def hops(path: DataFrame, symbols: DataFrame, most: int = 4) -> DataFrame:
    """The path with up to four definitions each hop may mean, and whether that is sure: ``candidates, resolution``."""
    low = ascii_lower(F.col("name"))
    nth = F.row_number().over(Window.partitionBy("low").orderBy("path", "byte_start"))
    own = symbols.withColumn("low", low).join(F.broadcast(path.select(ascii_lower(F.col("callee")).alias("low")).distinct()), "low", "left_semi")
    first = own.withColumn("r", nth).withColumn("n", F.count("*").over(Window.partitionBy("low"))).filter(F.col("r") <= most)
    held = first.groupBy("low").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.concat_ws("#", "path", F.col("byte_start").cast("string")))).alias("candidates"))
    out = path.withColumn("low", ascii_lower(F.col("callee"))).join(held, "low", "left")
    tier = F.when(F.col("n") == 1, "repository_unique").when(F.col("n") > 1, "ambiguous").otherwise("name_only")
    return out.select(*path.columns, F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"), tier.alias("resolution"))


def call_path(calls: DataFrame, symbols: DataFrame, start: str, goal: str, depth: int = PATH_DEPTH, most: int = PATH_NODES) -> DataFrame:
    """``hop, caller, callee`` of a shortest call path, empty if there is none within the caps.

    Breadth first, a frontier per hop. A name with several definitions is reached but not
    continued from. Predecessors are chosen by name, so the path is the same on every run.
    """
    edges = checkpoint(calls.select(ascii_lower(F.col("caller")).alias("a"), ascii_lower(F.col("callee")).alias("b")).filter("a <> b").distinct())
    unique = symbols.groupBy(ascii_lower(F.col("name")).alias("name")).agg(F.count("*").alias("n")).filter("n = 1").select("name")
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    spark = calls.sparkSession
    seen = spark.createDataFrame([(low(start), None, 0)], "name string, before string, hop int")
    front, found = seen, low(start) == low(goal)
    for hop in range(1, depth + 1):
        if found:
            break
        ready = front if hop == 1 else front.join(unique, "name", "left_semi")
        step = edges.join(ready.select(F.col("name").alias("a")), "a").groupBy(F.col("b").alias("name")).agg(F.min("a").alias("before"))
        front = checkpoint(step.join(seen.select("name"), "name", "left_anti").withColumn("hop", F.lit(hop)).orderBy("name").limit(most))
        if front.isEmpty():
            break
        seen = checkpoint(seen.unionByName(front))
        found = not front.filter(F.col("name") == low(goal)).isEmpty()
    rows, at = [], low(goal)
    while found and at != low(start):  # at most ``depth`` rows are fetched
        r = seen.filter(F.col("name") == at).first()
        rows.append((r["hop"], r["before"], at))
        at = r["before"]
    return spark.createDataFrame(rows, "hop int, caller string, callee string").orderBy("hop")
