"""Immutable generations of fact tables, incremental updates, and a stream that drives them.

A generation is a folder of Parquet tables in the session's store. It is complete before
the pointer file names it, and the pointer is replaced by a rename, so readers see the old
or the new state and a job lost on the way changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.sources import files as store

RESCAN = 1024  # more changed paths than this in a batch: scan everything
REBUILD = 16  # batches after which derived tables are built anew


class StrictError(RuntimeError):
    """A build that must be whole had failures; the old generation stays."""


class IdentityError(RuntimeError):
    """Stored vectors are of another model than the active one."""


def pointer(spark: SparkSession, root: str) -> dict:
    return json.loads(store.read_text(spark, f"{root}/_CURRENT") or '{"generation": 0, "tables": [], "identity": ""}')


def current(spark: SparkSession, root: str) -> int:
    return pointer(spark, root)["generation"]


def read(spark: SparkSession, root: str, name: str, generation: int | None = None) -> DataFrame | None:
    """The table as of ``generation`` (the current one by default); None before the first."""
    g = current(spark, root) if generation is None else generation
    return spark.read.parquet(f"{root}/generation={g}/{name}") if g else None


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], identity: str = "", failed: DataFrame | None = None, partition: dict[str, list[str]] | None = None) -> int:
    """Write a full generation and make it current only when all of it is there.

    With ``failed`` (files that could not be read) the build is strict: a row in it stops the
    build before anything becomes visible. ``partition`` names partition columns by table.
    """
    if failed is not None and not failed.isEmpty():
        raise StrictError("some files failed; the current generation stays")
    g = current(spark, root) + 1
    while store.exists(spark, f"{root}/generation={g}"):  # left by a job that did not finish
        g += 1
    for name, df in tables.items():
        writer = df.write
        if partition and name in partition:
            writer = writer.partitionBy(*partition[name])
        writer.parquet(f"{root}/generation={g}/{name}")
    state = json.dumps({"generation": g, "tables": sorted(tables), "identity": identity})
    store.write_text(spark, f"{root}/generation={g}/_COMPLETE", state)
    store.write_text(spark, f"{root}/_CURRENT", state)
    return g


def recover(spark: SparkSession, root: str) -> int:
    """Point to the newest generation that is complete and readable; damaged ones are set aside.

    Returns the generation (0 if there is none). A generation that a job left unfinished is not
    touched, since the job may still be running.
    """
    found = sorted((int(n.split("=")[1]) for n in store.names(spark, root) if n.startswith("generation=")), reverse=True)
    for g in found:
        state = store.read_text(spark, f"{root}/generation={g}/_COMPLETE")
        if state is None:
            continue
        try:
            for name in json.loads(state)["tables"]:
                spark.read.parquet(f"{root}/generation={g}/{name}").limit(1).collect()
        except Exception:  # noqa: BLE001 - whatever the reader says, the data cannot be read
            store.move(spark, f"{root}/generation={g}", f"{root}/quarantine={g}")
            continue
        store.write_text(spark, f"{root}/_CURRENT", state)
        return g
    if store.exists(spark, f"{root}/_CURRENT"):
        store.remove(spark, f"{root}/_CURRENT")
    return 0


def same_identity(spark: SparkSession, root: str, identity: str) -> None:
    """Refuse to compare vectors of one model with queries of another."""
    held = pointer(spark, root).get("identity", "")
    if held != identity:
        raise IdentityError(f"the index holds vectors of {held!r}, not of {identity!r}")


def status(spark: SparkSession, root: str) -> dict:
    """Generation, identity, and the rows of each table."""
    p = pointer(spark, root)
    return p | {"rows": {t: read(spark, root, t).count() for t in p["tables"]}}


def body_hash(text: Column) -> Column:
    """A hash of the text without the blank and comment lines at its end."""
    return F.sha2(F.regexp_replace(text, r"(?:\n[ \t\r]*(?:(?://|#|--|;)[^\n]*|\*/|/\*[^\n]*)?)+\s*$", ""), 256)


def change_kind(new: DataFrame, old: DataFrame) -> DataFrame:
    """``path, change``: what an update must do for each file, by three fingerprints.

    Both sides have ``path, content_hash, body, structure``. ``same`` needs nothing, ``tail`` new
    lines only (blank or comment lines at the end), ``structure`` new lines and texts but no new
    symbols or edges, ``changed`` and ``new`` everything, ``gone`` a removal.
    """
    a, b = new.select("path", F.col("content_hash").alias("c1"), F.col("body").alias("b1"), F.col("structure").alias("s1")), old.select("path", F.col("content_hash").alias("c0"), F.col("body").alias("b0"), F.col("structure").alias("s0"))
    kind = F.when(F.col("c0").isNull(), "new").when(F.col("c1").isNull(), "gone").when(F.col("c0") == F.col("c1"), "same").when(F.col("b0") == F.col("b1"), "tail").when(F.col("s0") == F.col("s1"), "structure").otherwise("changed")
    return a.join(b, "path", "full").select("path", kind.alias("change"))


def unchanged(new: DataFrame, old: DataFrame, identity: str = "") -> DataFrame:
    """New files whose path, content hash and model identity are already indexed."""
    return new.join(old.filter(F.coalesce(F.col("identity"), F.lit("")) == identity).select("path", "content_hash"), ["path", "content_hash"], "left_semi")


def changed(new: DataFrame, old: DataFrame, identity: str = "") -> DataFrame:
    return new.join(old.filter(F.coalesce(F.col("identity"), F.lit("")) == identity).select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def upsert(old: DataFrame | None, new: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Old rows of other paths and the new rows; paths in ``gone`` and below them are dropped."""
    if old is None:
        return new
    kept = old.join(new.select("path").distinct(), "path", "left_anti")
    if gone is not None:
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        below = kept.select("path").distinct().select("path", F.explode(above).alias("g"))
        dropped = below.join(gone.select(F.col("path").alias("g")), "g", "left_semi").select("path").distinct()
        kept = kept.join(dropped, "path", "left_anti")
    return kept.unionByName(new)


def prune(old: DataFrame, walked: DataFrame, complete: bool, language: str | None = None) -> DataFrame:
    """Drop files that a complete walk no longer finds, within the language walked; else keep all."""
    if not complete:
        return old
    here = walked.select("path").distinct().withColumn("__there", F.lit(True))
    other = F.lit(False) if language is None else F.coalesce(F.col("language") != language, F.lit(True))
    return old.join(here, "path", "left").filter(F.col("__there").isNotNull() | other).drop("__there")


def stream(changes: DataFrame, root: str, build: Callable[[DataFrame], DataFrame], checkpoint: str, rescan: Callable[[], DataFrame] | None = None, interval: str = "300 milliseconds", derived: Callable[[DataFrame], dict[str, DataFrame]] | None = None, every: int = REBUILD):
    """Start a stream of file events ``path, content, deleted, at`` that publishes generations.

    In a batch the last event of a path wins. Batches of more than ``RESCAN`` paths call
    ``rescan`` where given. A batch that is run again writes the same state once more. The
    tables that ``derived`` makes of the files are built anew every ``every`` batches and
    carried over in between.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("path").agg(F.max(F.struct("at", "deleted", "content")).alias("e")).select("path", "e.deleted", "e.content")
        last = last.persist()
        try:
            n = last.count()
            if not n:
                return
            if n > RESCAN and rescan is not None:
                files = build(rescan())
            else:
                new = build(last.filter("NOT deleted").select("path", "content"))
                files = upsert(read(spark, root, "files"), new, last.filter("deleted").select("path"))
            held = [t for t in pointer(spark, root)["tables"] if t != "files"]
            more = derived(files) if derived is not None and (number % every == 0 or not held) else {t: read(spark, root, t) for t in held}
            publish(spark, root, {"files": files, **more})
        finally:
            last.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
