"""Problem 8: filling fixed-capacity containers with documents.

Bulk-synchronous best fit. Documents are sorted by size, gaps (containers with room) by
room. A round matches all documents of the largest size left with their successors, the
tightest gaps that hold them; where several want one gap they are served by rank, the
gaps shrink, and the next round follows. Documents without a gap open new containers.

Documents of one size are interchangeable, and so are gaps of one room. The sweeps
therefore run over the at most ``capacity`` size classes and match whole rank ranges
of documents to rank ranges of gaps; the ranges number a few per size and round,
whatever the row count. The rows themselves are range-sorted once: each document is
ranked within its size in parallel and finds its container by one broadcast join
with the ranges. No row visits the driver and no group stays in one task.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.prefix import salted_rank
from siftspark.session import checkpoint
from siftspark.sources.tables import table

CAPACITY = 512
TOKEN = r"[\p{L}\p{Nd}_]+|(?U:[^\p{L}\p{Nd}_\s]+)"


def sweep(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Match size classes to containers: rows ``(size, rank_from, rank_to, container_from)``.

    Documents of ``size`` with ranks ``rank_from <= r < rank_to`` go to the containers
    ``container_from + (r - rank_from)``.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> ranges of containers
    out, opened = [], 0
    for size in sorted((s for s, n in histogram.items() if n > 0), reverse=True):
        left, rank = histogram[size], 0

        def fill(room: int, first: int, many: int, size: int = size) -> list[tuple[int, int, int]]:
            """Give each of the containers as many documents as fit; what is left of them by room."""
            nonlocal left, rank
            each = room // size
            rest = []
            full = min(many, left // each)
            if full:
                for k in range(each):
                    out.append((size, rank + k * full, rank + (k + 1) * full, first))
                rank, left = rank + each * full, left - each * full
                rest.append((room - each * size, first, full))
            if full < many and left:  # one more takes the last documents
                n = min(left, each)
                for k in range(n):
                    out.append((size, rank + k, rank + k + 1, first + full))
                rank, left = rank + n, left - n
                rest.append((room - n * size, first + full, 1))
                full += 1
            if full < many:
                rest.append((room, first + full, many - full))
            return rest

        for room in sorted(r for r in gaps if r >= size):  # successors: the tightest gap first
            if not left:
                break
            for first, many in gaps.pop(room):
                for r, f, m in fill(room, first, many) if left else [(room, first, many)]:
                    if r:
                        gaps[r].append((f, m))
        if left:  # nothing has room: new containers, as full of this size as they get
            many = -(-left // (capacity // size))
            for r, f, m in fill(capacity, opened, many):
                if r:
                    gaps[r].append((f, m))
            opened += many
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", per_task: int = 200_000) -> DataFrame:
    """Assign every document to containers of ``capacity`` tokens.

    Returns one row per piece: ``container, room`` (unused tokens of that container),
    ``<key>, piece, pieces, token_from, token_to, tokens``. Only a document larger than
    ``capacity`` is cut: into full containers and one rest, which is packed like a
    document. A null text, an empty one or one of white space has no token and takes
    no room: it gives no row. A null key gives no row. Repeated rows of a key count
    once (the longest text is kept). Extra columns are ignored. An empty table gives no
    rows. Equal sizes are ordered by key, so the result is the same on every run.
    """
    spark: SparkSession = docs.sparkSession
    sized = docs.select(F.col(key).alias("__id"), F.regexp_count(F.col(text), F.lit(TOKEN)).cast("long").alias("__n"))
    sized = checkpoint(sized.filter("__id IS NOT NULL AND __n > 0").groupBy("__id").agg(F.max("__n").alias("__n")))
    full = sized.filter(F.col("__n") >= capacity).select("__id", "__n", F.explode(F.sequence(F.lit(0), (F.col("__n") / capacity).cast("long") - 1)).alias("piece"))
    full = full.select("__id", "piece", F.lit(capacity).cast("long").alias("size"), "__n")
    rest = sized.withColumn("size", F.col("__n") % capacity).filter("size > 0").select("__id", F.floor(F.col("__n") / capacity).alias("piece"), "size", "__n")
    histogram = {r["size"]: r["count"] for r in rest.groupBy("size").count().collect()}  # at most capacity - 1 rows
    ranges = sweep(histogram, capacity)
    table_ = spark.createDataFrame([(int(a), int(b), int(c), int(d)) for a, b, c, d in ranges] or [(-1, 0, 0, 0)], "__size long, __from long, __to long, __first long")
    ranked = salted_rank(rest, "size", "__id", per_task, histogram)
    hit = (F.col("size") == F.col("__size")) & (F.col("rank") >= F.col("__from")) & (F.col("rank") < F.col("__to"))
    packed = ranked.join(F.broadcast(table_), hit).select("__id", "piece", "size", "__n", (F.col("__first") + F.col("rank") - F.col("__from")).alias("container"))
    filled = packed.groupBy("container").agg(F.sum("size").alias("__used"), F.collect_list(F.struct("__id", "piece", "size", "__n")).alias("__d"))  # at most capacity entries each
    packed = filled.select("container", (F.lit(capacity) - F.col("__used")).alias("room"), F.inline("__d"))
    # full pieces own a container each, named by document and piece
    whole = full.select(F.concat(F.lit("d"), F.col("__id"), F.lit("."), F.col("piece")).alias("container"), F.lit(0).cast("long").alias("room"), "__id", "piece", "size", "__n")
    both = packed.withColumn("container", F.concat(F.lit("s"), F.col("container"))).unionByName(whole)
    begin = F.col("piece") * capacity
    return both.select("container", "room", F.col("__id").alias(key), "piece", F.ceil(F.col("__n") / capacity).alias("pieces"), begin.alias("token_from"), (begin + F.col("size")).alias("token_to"), F.col("size").alias("tokens"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the packing had to cut."""
    return pack(table(spark, folder, "documents")).filter("pieces > 1 AND piece = 0").select("doc_id").distinct()


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every container with its documents and its unused room."""
    packed = pack(table(spark, folder, "documents"))
    piece = F.sort_array(F.collect_list(F.struct("doc_id", "piece", "tokens")))
    return packed.groupBy("container").agg(F.max("room").alias("room"), piece.alias("pieces"))


def p8_balance(spark: SparkSession, folder: str) -> DataFrame:
    """What the packing must keep: per document its tokens and pieces, all in containers within capacity.

    ``container_tokens`` is what the document's containers hold at most; ``containers`` is the
    number of containers in all, which the SQL gives as the least possible number.
    """
    packed = pack(table(spark, folder, "documents"))
    used = packed.groupBy("container").agg(F.sum("tokens").alias("used"), F.max("room").alias("room"))
    good = used.agg(F.count("*").alias("containers"), F.sum((F.col("used") + F.col("room") != CAPACITY).cast("long")).alias("unbalanced"), F.max(F.col("used") <= CAPACITY).alias("within"))
    each = packed.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.max("token_to").alias("token_to"))
    return each.crossJoin(F.broadcast(good))


QUERIES = {"p8_found": p8_found, "p8_containers": p8_containers, "p8_balance": p8_balance}
SQL = {
    "p8_balance": r"""
WITH t AS (SELECT doc_id, max(len(regexp_extract_all(text, '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_\s\p{Z}\x0B\x85]+'))) AS tokens FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id, tokens::BIGINT AS tokens, ceil(tokens / 512.0)::BIGINT AS pieces, tokens::BIGINT AS token_to, (SELECT (sum(tokens // 512) + ceil(sum(tokens % 512) / 512.0))::BIGINT FROM t) AS containers, 0::BIGINT AS unbalanced, true AS within
FROM t WHERE tokens > 0""",
    "p8_found": r"""
SELECT DISTINCT doc_id FROM documents
WHERE len(regexp_extract_all(text, '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_\s]+')) > 512""",
}
