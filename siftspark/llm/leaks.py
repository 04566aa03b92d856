"""Problem 9: evaluation texts that occur in documents, whole or in part.

Q-gram lemma filtering. Texts are normalised to words joined by single blanks. Two
passages of ``w`` characters within ``e`` edits share at least ``w + 1 - q(e + 1)``
q-grams, and their positions differ by a nearly constant amount: they lie in one
diagonal band.

1. The q-grams of all items set the bits of one filter, whose size follows the items up
   to 32 MB. It is built in parallel and broadcast.
2. The documents are read once, whatever the number of items: a vectorised rolling hash
   gives their q-grams, and the stretches in which enough of them pass the filter are
   kept. All else of the documents is left where it is.
3. The q-grams of the stretches are joined with every ``m``-th of the items' q-grams and
   counted in overlapping diagonal bands; bands that reach the bound of the item's shortest
   window are regions. Of the ``w - q + 1`` q-grams of a passage that share is sampled, and
   an edit spoils at most ``q / m`` of those (rounded up), which gives the bound.
4. Regions are verified by a banded alignment, vectorised over the windows of the item;
   without edits an exact comparison of the words follows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.session import checkpoint
from siftspark.sources.tables import table

MIN_WORDS = 10
MAX_BITS = 28  # the filter has at most 2^28 bits
CHUNKS = 64  # pieces in which the filter is put together
SAMPLES = 4  # sampled q-grams that a passage must keep
SLICE_CHARS = 4_000_000  # characters of documents hashed at once
_CF = regex.compile(r"\p{Cf}+")
_WORD = regex.compile(r"[\p{L}\p{Nd}]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Runs of letters and digits after NFKC, removal of format characters, lower-casing."""
    if not text.isascii():
        text = _CF.sub("", unicodedata.normalize("NFKC", text))
    return _WORD.findall(text.lower())


def _hashes(text: str, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram of ``text``, by position."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(x) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, width, at = None, 1, 0
    power = x + np.uint64(1)  # hash of the 2^k characters from each position on, by doubling
    factor = _MULT
    left = q
    while left:
        if left & 1:
            part = power[at : at + n]
            h = part.copy() if h is None else h * factor + part
            at += width
        left >>= 1
        if left:
            power = power[:-width] * factor + power[width:]
            width *= 2
            with np.errstate(over="ignore"):
                factor = factor * factor + np.uint64(2)
    h ^= h >> np.uint64(29)
    return h * _MULT


def windows(text: str, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of ``min_words`` words of a normalised text."""
    size = np.array([len(w) + 1 for w in text.split(" ")], np.int64)
    if len(size) < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    return start[: len(size) - min_words + 1], start[min_words:] - start[:-min_words] - 1


def _bit(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def stretches(at: np.ndarray, width: int, need: int) -> np.ndarray:
    """Which of the sorted positions lie in some window of ``width`` that holds at least ``need`` of them."""
    last = np.searchsorted(at, at + width)
    full = np.flatnonzero(last - np.arange(len(at)) >= need)
    mark = np.zeros(len(at) + 1, np.int64)
    np.add.at(mark, full, 1)
    np.add.at(mark, last[full], -1)
    return np.cumsum(mark[:-1]) > 0


def aligned(item: np.ndarray, starts: np.ndarray, sizes: np.ndarray, text: np.ndarray, low: int, high: int, edits: int) -> np.ndarray:
    """Which windows of ``item`` occur in ``text`` within ``edits`` edits on the diagonals ``low`` to ``high``.

    A banded alignment of all windows at once: a column per diagonal (position in the text less
    position in the item), a step per character. Beginning and end in the text are free.
    """
    diag = np.arange(low - edits, high + edits + 1)
    padded = np.concatenate([np.zeros(1, text.dtype), text, np.zeros(1, text.dtype)])  # 0 matches nothing
    if len(diag) == 1:  # a band of one diagonal has no gaps: the cost of a window is its number of mismatches
        place = np.clip(np.arange(len(item)) + low + 1, 0, len(padded) - 1)
        cost = np.concatenate([[0], np.cumsum(padded[place] != item)])
        return cost[np.minimum(starts + sizes, len(item))] - cost[starts] <= edits
    cost = np.zeros((len(starts), len(diag)), np.int16)
    out = np.zeros(len(starts), bool)
    for i in range(int(sizes.max(initial=0)) + 1):
        done = sizes == i
        if done.any():
            out[done] = (cost[done] <= edits).any(1)
        live = sizes > i
        if not live.any() or not (cost[live] <= edits).any():
            break
        at = np.minimum(starts + i, len(item) - 1)
        place = np.clip(at[:, None] + diag[None, :] + 1, 0, len(padded) - 1)
        step = cost + (padded[place] != item[at][:, None])
        if edits:
            step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # a character of the item is missing in the text
            for _ in range(edits):  # the text has characters more
                step[:, 1:] = np.minimum(step[:, 1:], step[:, :-1] + 1)
        cost = np.minimum(step, edits + 1).astype(np.int16)
    return out


def shares_words(text: str, item: str, min_words: int) -> bool:
    """Do ``min_words`` words running of the item stand in the text?"""
    index: dict[str, list[int]] = {}
    for j, w in enumerate(item.split(" ")):
        index.setdefault(w, []).append(j)
    run: dict[int, int] = {}
    for w in text.split(" "):  # runs of equal words
        run = {j: run.get(j - 1, 0) + 1 for j in index.get(w, ())}
        if run and max(run.values()) >= min_words:
            return True
    return False


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _filter(grams: DataFrame, bits: int) -> np.ndarray:
    """The bits of all hashes: a part in each task, put together by pieces."""
    size = (1 << bits) // CHUNKS

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(1 << bits, bool)
        for f in frames:
            own[_bit(f["h"].values.view(np.uint64), bits)] = True
        for k in range(CHUNKS):
            piece = own[k * size : (k + 1) * size]
            if piece.any():
                yield pd.DataFrame({"k": [k], "b": [np.packbits(piece).tobytes()]})

    def join(f: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(size // 8, np.uint8)
        for b in f["b"]:
            out |= np.frombuffer(b, np.uint8)
        return pd.DataFrame({"k": f["k"].iloc[:1], "b": [out.tobytes()]})

    whole = np.zeros(1 << bits, bool)
    for r in grams.select("h").mapInPandas(part, "k int, b binary").groupBy("k").applyInPandas(join, "k int, b binary").toLocalIterator():
        whole[r["k"] * size : (r["k"] + 1) * size] = np.unpackbits(np.frombuffer(r["b"], np.uint8)).astype(bool)
    return whole


def leaks(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, q: int = 14, edits: int = 0, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Pairs ``(<key>, <item_key>)`` where the document repeats ``min_words`` words of the item.

    ``edits`` is the number of character edits that the passage may hold. Items with
    fewer than ``min_words`` words match nothing. Null keys or texts and empty texts give
    no row; repeated rows give one; extra columns are ignored; an empty table on either
    side gives an empty result. Texts are read whole, of any length.
    """
    spark: SparkSession = docs.sparkSession
    key_type, item_type = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()

    def prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            t = [" ".join(words(x)) for x in f["x"]]
            shortest = [int(windows(x, min_words)[1].min(initial=1 << 30)) for x in t]
            out = pd.DataFrame({"item": f["item"], "t": t, "shortest": shortest})
            out = out[out["shortest"] < 1 << 30]
            if len(out):
                yield out

    source = items.select(F.col(item_key).alias("item"), F.col(text).alias("x")).filter("item IS NOT NULL AND x IS NOT NULL")
    known = source.mapInPandas(prepare, f"item {item_type}, t string, shortest int").distinct()
    known = checkpoint(known.withColumn("iid", F.xxhash64("item", "t")))
    r = known.agg(F.min("shortest"), F.max("shortest"), F.sum(F.length("t"))).first()
    if r[0] is None:
        return spark.createDataFrame([], f"{key} {key_type}, {item_key} {item_type}")
    q = max(1, min(q, r[0] // (edits + 1)))
    # a passage holds a part as long as the shortest window, in which at least ``least`` of ``tight`` positions pass
    least, tight, width = max(1, r[0] + 1 - q * (edits + 1)), r[0] + edits - q + 1, r[1] + edits
    # the diagonals of a passage differ by at most ``edits``: such a range lies in a band of 2 e + 1 that begins at a multiple of e + 1
    step = edits + 1
    sampled = lambda w, m: (w - q + 1) // m - edits * -(-q // m)  # noqa: E731 - what a passage of w characters keeps of every m-th q-gram
    every = max((m for m in range(1, r[0] - q + 2) if sampled(r[0], m) >= SAMPLES), default=1)
    bits = int(min(MAX_BITS, max(16, np.ceil(np.log2(16 * r[2])))))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, t in zip(f["iid"], f["t"]):
                h = _hashes(t, q)
                yield pd.DataFrame({"h": h.view(np.int64), "iid": i, "place": np.arange(len(h), dtype=np.int32)})

    grams = checkpoint(known.select("iid", "t").mapInPandas(cut, "h long, iid long, place int"))
    shared = spark.sparkContext.broadcast(np.packbits(_filter(grams, bits)).tobytes())

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passes = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool)
        for frame in frames:
            ids, texts, held = [], [], 0
            for i, t in zip(frame["k"], frame["t"]):
                t = " ".join(words(t))
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held > SLICE_CHARS:
                    yield from slice_(passes, ids, texts)
                    ids, texts, held = [], [], 0
            yield from slice_(passes, ids, texts)

    def slice_(passes: np.ndarray, ids: list, texts: list[str]) -> Iterator[pd.DataFrame]:
        if not ids:
            return
        starts = np.cumsum([0, *(len(t) + q for t in texts)])[:-1]
        h = _hashes(("\x00" * q).join(texts), q)
        at = np.flatnonzero(passes[_bit(h, bits)])
        at = at[stretches(at, tight, least)]
        if not len(at):
            return
        doc = np.searchsorted(starts, at, "right") - 1
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > width)])
        out = []
        for a, b in zip(new, np.r_[new[1:], len(at)]):
            d = int(doc[a])
            t, first, last = texts[d], int(at[a] - starts[d]), int(at[b - 1] - starts[d])
            lo = t.rfind(" ", 0, max(0, first - width) + 1) + 1
            hi = t.find(" ", min(len(t), last + q + width))
            out.append((ids[d], t[lo : hi if hi >= 0 else len(t)], h[at[a:b]].view(np.int64), (at[a:b] - starts[d] - lo).astype(np.int32)))
        yield pd.DataFrame(out, columns=["k", "seg", "hs", "ps"])

    read = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("k IS NOT NULL AND t IS NOT NULL AND t <> ''")
    held = read.mapInPandas(find, f"k {key_type}, seg string, hs array<long>, ps array<int>")
    held = checkpoint(held.withColumn("sid", F.monotonically_increasing_id()))
    hits = held.select("sid", F.inline(F.arrays_zip(F.col("hs").alias("h"), F.col("ps").alias("pos")))).join(grams.filter(F.col("place") % every == 0), "h").withColumn("diag", F.col("pos") - F.col("place"))
    home = F.floor(F.col("diag") / step)
    bands = F.when(F.pmod("diag", F.lit(step)) < edits, F.array(home, home - 1)).otherwise(F.array(home))
    banded = hits.withColumn("band", F.explode(bands))
    counted = banded.groupBy("sid", "iid", "band").agg(F.count_distinct("pos").alias("n"), F.min("diag").alias("low"), F.max("diag").alias("high"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    bound = F.greatest(F.lit(1), F.floor((F.col("shortest") - q + 1) / every) - edits * -(-q // every))
    regions = counted.join(known, "iid").filter(F.col("n") >= bound).join(held.select("sid", "k", "seg"), "sid").select("k", "item", "seg", "t", "low", "high", "first", "last")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            good = []
            for seg, t, low, high, first, last in f[["seg", "t", "low", "high", "first", "last"]].itertuples(index=False):
                start, size = windows(t, min_words)
                near = (start + size + high + edits >= first - width) & (start + low - edits <= last + q + width)
                ok = bool(near.any()) and bool(aligned(_codes(t), start[near], size[near], _codes(seg), int(low), int(high), edits).any())
                if ok and not edits:  # the equal characters must be whole words
                    lo = seg.rfind(" ", 0, max(0, int(first) - width) + 1) + 1
                    hi = seg.find(" ", min(len(seg), int(last) + q + width))
                    ok = shares_words(seg[lo : hi if hi >= 0 else len(seg)], t, min_words)
                good.append(ok)
            out = f.loc[good, ["k", "item"]]
            if len(out):
                yield out

    found = regions.mapInPandas(verify, f"k {key_type}, item {item_type}").distinct()
    return found.select(F.col("k").alias(key), F.col("item").alias(item_key))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that repeat ten words of an evaluation text, with that text."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_near(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that repeat ten words of an evaluation text with at most two characters changed."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), q=8, edits=2)


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents each leaked evaluation text occurs in."""
    return p9_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_docs"))


QUERIES = {"p9_found": p9_found, "p9_near": p9_near, "p9_items": p9_items}
SQL: dict[str, str] = {}
