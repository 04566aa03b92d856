"""Ranks and running sums over ordered groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.session import checkpoint


def prefix_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add for each ``name: value`` of ``sums`` the exclusive running sum of ``value``.

    The rows are range-partitioned by ``group + order``, so a large group spans
    several tasks. Each task sums its own part; the totals of earlier parts are
    added to the parts of groups that span tasks. Such (part, group) entries are
    at most two a part, hence the broadcast is bounded by the partition count.
    ``group + order`` must identify a row (aggregate ties first); nulls sort first.
    """
    names = list(sums)
    keyed = df.withColumns({f"__v_{n}": F.coalesce(v, F.lit(0)) for n, v in sums.items()})
    placed = checkpoint(keyed.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))
    local = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumns({n: F.sum(f"__v_{n}").over(local) - F.col(f"__v_{n}") for n in names})
    parts = placed.groupBy("__part", *group).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in names])
    edges = placed.groupBy("__part").agg(F.min(F.struct(*group)).alias("__lo"), F.max(F.struct(*group)).alias("__hi"))
    ends = edges.select("__part", F.explode(F.array_distinct(F.array("__lo", "__hi"))).alias("__g"))
    same = [F.col(f"__g.{c}").eqNullSafe(F.col(f"__p.{c}")) for c in group]
    spanning = ends.alias("e").join(parts.alias("__p"), [F.col("e.__part") == F.col("__p.__part"), *same], "inner")
    spanning = spanning.select("__p.*")
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spanning.select("__part", *group, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in names])
    offsets = offsets.filter(" OR ".join(f"__o_{n} <> 0" for n in names))
    offsets = offsets.select(F.col("__part").alias("__op"), *[F.col(c).alias(f"__k_{c}") for c in group], *[f"__o_{n}" for n in names])
    on = [F.col("__part") == F.col("__op"), *[F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in group]]
    joined = out.join(F.broadcast(offsets), on, "left")
    return joined.select(*df.columns, *[(F.col(n) + F.coalesce(F.col(f"__o_{n}"), F.lit(0))).alias(n) for n in names])


def salted_rank(df: DataFrame, key: str, order: str, per_task: int, counts: dict) -> DataFrame:
    """Add ``rank``: the number of the row, from 0, among the rows of equal ``key``.

    Keys with more than ``per_task`` rows by ``counts`` are split by a hash of
    ``order``, each split is numbered on its own and shifted by the sizes of the
    splits before it. The order is fixed by the data, not by the partitions. The
    shift table has (number of keys + rows / ``per_task``) rows.
    """
    spark = df.sparkSession
    splits = {k: -(-n // per_task) for k, n in counts.items() if n > per_task}
    table = spark.createDataFrame([(int(k), int(s)) for k, s in splits.items()] or [(-1, 1)], "__k long, __s long")
    salted = df.join(F.broadcast(table), F.col(key) == F.col("__k"), "left").withColumn("__salt", F.pmod(F.xxhash64(order), F.coalesce("__s", F.lit(1)))).drop("__k", "__s")
    sizes = salted.groupBy(key, "__salt").count()
    shift = sizes.select(F.col(key).alias("__k"), F.col("__salt").alias("__s"), (F.sum("count").over(Window.partitionBy(key).orderBy("__salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")).alias("__shift"))
    local = F.row_number().over(Window.partitionBy(key, "__salt").orderBy(order)) - 1
    ranked = salted.withColumn("__local", local)
    joined = ranked.join(shift, (F.col(key) == F.col("__k")) & (F.col("__salt") == F.col("__s")))
    return joined.select(*df.columns, (F.col("__local") + F.col("__shift")).cast("long").alias("rank"))


def crowded(df: DataFrame, group: list[str], per_task: int) -> DataFrame | None:
    """The groups of more than ``per_task`` rows (at most rows / ``per_task`` of them), or None if there is none."""
    big = checkpoint(df.groupBy(*group).agg(F.count("*").alias("__n")).filter(F.col("__n") > per_task).select(*group))
    return None if big.isEmpty() else big


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, per_task: int = 200_000) -> DataFrame:
    """Add ``name``: the number of the row, from 1, within its group in the given order.

    Groups are numbered by a window each; those of more than ``per_task`` rows by distributed
    prefix sums, so none has to fit a task. ``group + order`` must identify a row.
    """
    number = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
    big = crowded(df, group, per_task)
    if big is None:
        return df.withColumn(name, number)
    same = [df[c].eqNullSafe(big[c]) for c in group]
    few = df.join(big, same, "left_anti").withColumn(name, number)
    many = prefix_sums(df.join(big, same, "left_semi"), group, order, {name: F.lit(1)}).withColumn(name, (F.col(name) + 1).cast("long"))
    return few.unionByName(many)
