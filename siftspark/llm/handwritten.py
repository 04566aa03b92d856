"""Problem 3: generated, minified, vendored and data files among source files.

1. Inverted index of line hashes: the lines of a file are hashed; a line that several
   files hold belongs to the oldest of them (its owner). Every other holder of another
   repository gives one vote (file, owner), so the index yields as many rows as it has
   entries, never the pairs of a posting list. Owners with enough votes are compared
   exactly: the share of the file's distinct lines that the owner holds. A share of
   ``containment`` or more makes the file a copy of it, local edits included. Files of
   equal lines count as one set. Files that the owners leave open are compared with every
   older set that holds one of their rarest lines (prefix filter), so no copy is lost.
2. Token composition of the remaining files, from sums over their lines: marks in the
   leading comment, share of encoded data, of text in over-long lines without blanks,
   of numbered stubs, and the folders and suffixes of the path.

Lines are reduced to a hash and a few numbers before the first shuffle. All expressions
are built in; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark.session import checkpoint
from siftspark.sources.tables import table

# Extensions of source code (fixed values).
SOURCE = "py pyi pyx js jsx mjs cjs ts tsx mts cts go rs java cs rb c h cc cpp cxx hpp hh hxx kt kts swift php scala m mm lua pl pm r jl ex exs erl hs ml dart groovy sh bash vue svelte css scss less sql".split()
# Folders of third-party code (fixed values).
VENDORED = "vendor vendors vendored third_party third-party thirdparty 3rdparty 3rd_party node_modules godeps extern external externals deps bower_components jspm_packages pods carthage site-packages _vendor".split()
_GEN = (
    r"(?i)@generated\b|<auto-?generated|^\W*auto-?generated (?:file|code)\b|\bauto-?generated by\b|code generated (?:by|from)\b.*|\b(?:this )?(?:file|code|source|class|module) (?:is|was|has been) (?:auto(?:matically)?[- ]?)?(?:generated|produced|created|built|emitted) (?:by|from|with|using|automatically)\b"
    r"|^\W*(?:auto(?:matically)?[- ]?)(?:generated|created|produced) (?:by|from|with|using)\b|^\W*generated (?:by|from|with|using)\b|^\W*do not (?:edit|modify)\b|\b(?:manual|hand) (?:changes|edits) will be (?:lost|overwritten)"
)
_TP = r"(?i)^\W*third[- ]party code\b|^\W*(?:copied|vendored|imported|taken|adapted|forked) from \S+|upstream changes go there|distributed under the terms in the \S+ licen[sc]e|^\W*vendored (?:copy|dependency)|^\W*(?:local|verbatim|unmodified) copy of"
_DATA = r"[A-Za-z0-9+/=]{40,}|(?:0[xX][0-9a-fA-F]{1,8}|-?\d{1,5})(?:\s*,\s*(?:0[xX][0-9a-fA-F]{1,8}|-?\d{1,5})){7,}|(?:\\x[0-9a-fA-F]{2}){8,}"
_GENPATH = r"(?i)(?:^|/)(?:gen|generated|__generated__|autogen|auto_generated)/|[._-](?:g|gen|generated|designer|pb|pb2|pb2_grpc|pb\.gw|grpc)\.[a-z]+$"
_MINPATH = r"(?i)[.-](?:min|bundle|prod|production)\.(?:[cm]?jsx?|css)$"
LONG = 250


def _path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^\./", "")


def classify(files: DataFrame, lines: DataFrame, containment: float = 0.8, min_lines: int = 8) -> DataFrame:
    """``file_id, kind, copied_from, share`` for each file that no one wrote by hand.

    ``kind`` is the first that holds of generated, minified, data, vendored and copied. Files
    without a source extension give no row. A file delivered twice counts once (its latest
    delivery), a line delivered twice once; null contents count as empty, null paths or ids
    give no row; files without lines are judged by path alone. Empty tables give an empty
    result.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    newest = F.max(F.struct("indexed_at", "path", "repo", "mtime")).alias("f")
    once = files.filter("file_id IS NOT NULL AND path IS NOT NULL").groupBy("file_id").agg(newest)
    file = once.select("file_id", _path(F.col("f.path")).alias("path"), "f.repo", "f.mtime").filter(ext.isin(SOURCE))
    text = F.trim(F.translate(F.coalesce("content", F.lit("")), "\t\r", "  "))
    comment = F.col("t").rlike(r"^(?://|#(?!include|define|if|el|endif|pragma|undef|\[|!\[)|/\*|\*|--|<!--|;;|\"\"\"|''')")
    # what encoded data must hold, in cheap tests: seven commas, an escape, or a long run of one alphabet
    commas = F.length("t") - F.length(F.translate("t", ",", "")) >= 7
    coded = (F.length("t") >= 20) & (commas | F.col("t").contains("\\x") | ((F.length("t") >= 40) & F.col("t").rlike(r"[A-Za-z0-9+/=]{40}")))
    stub = F.when(F.length("t") <= 17, F.regexp_extract("t", r"^(?:return )?(\d{1,9});?$", 1)).otherwise("")
    lean = lines.filter("file_id IS NOT NULL AND line_no IS NOT NULL").select("file_id", "line_no", text.alias("t")).filter("t <> ''")
    lean = lean.select(
        "file_id", "line_no", F.length("t").alias("n"), F.when(F.length("t") >= 16, F.xxhash64("t")).alias("h"), comment.alias("comment"),
        (comment & F.col("t").rlike(_GEN)).alias("gen"), (comment & F.col("t").rlike(_TP)).alias("tp"), F.col("t").rlike(r"^(?:<\?php|#!)").alias("open"),
        F.when(coded, F.length("t") - F.length(F.regexp_replace("t", _DATA, ""))).otherwise(0).alias("data"),
        F.when(F.length("t") > LONG, F.length("t") - F.length(F.translate("t", " ", ""))).otherwise(0).alias("blanks"),
        F.when(stub != "", stub.cast("long")).alias("stub"), F.col("t").contains("sourceMappingURL=").alias("map"),
    )
    lean = lean.dropDuplicates(["file_id", "line_no"])
    lean = checkpoint(lean)
    code = ~F.col("comment") & ~F.col("open")
    per = lean.groupBy("file_id").agg(
        F.sum("n").alias("chars"), F.sum(F.when(code, 1).otherwise(0)).alias("code"), F.sum("data").alias("data"),
        F.sum(F.when(~F.col("comment"), F.col("n")).otherwise(0)).alias("code_chars"),
        F.sum(F.when((F.col("n") > LONG) & ~F.col("comment"), F.col("n")).otherwise(0)).alias("long"), F.sum(F.when(~F.col("comment"), F.col("blanks")).otherwise(0)).alias("blanks"),
        F.min(F.when(code, F.col("line_no"))).alias("first"), F.min(F.when(F.col("gen"), F.col("line_no"))).alias("gen_at"), F.min(F.when(F.col("tp"), F.col("line_no"))).alias("tp_at"),
        F.count("stub").alias("stubs"), F.min("stub").alias("lo"), F.max("stub").alias("hi"), F.sum("stub").alias("total"), F.max("map").alias("map"),
    )
    leads = lambda c: F.col(c).isNotNull() & (F.col(c) < F.coalesce("first", F.lit(2**31 - 1)))
    series = (F.col("stubs") >= 5) & (F.col("hi") - F.col("lo") + 1 == F.col("stubs")) & (F.col("total") * 2 == F.col("stubs") * (F.col("lo") + F.col("hi"))) & (F.col("stubs") >= 0.2 * F.col("code"))
    minified = (F.col("long") > 0.7 * F.col("code_chars")) & (F.col("blanks") < 0.15 * F.col("long"))
    encoded = F.col("data") > 0.6 * F.col("code_chars")
    folders = F.slice(F.split(F.lower("path"), "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1)))
    in_vendor = F.arrays_overlap(folders, F.array(*[F.lit(v) for v in VENDORED]))
    no = F.lit(False)
    kind = (
        F.when(F.coalesce(leads("gen_at"), no) | F.coalesce(series, no) | F.col("path").rlike(_GENPATH), "generated")
        .when(F.coalesce(minified, no) | (F.coalesce("map", no) & F.col("path").rlike(_MINPATH)), "minified")
        .when(F.coalesce(encoded, no), "data")
        .when(in_vendor | F.coalesce(leads("tp_at"), no), "vendored")
    )
    judged = checkpoint(file.join(per, "file_id", "left").withColumn("kind", kind).select("file_id", "repo", "mtime", "kind"))
    # the index of lines, over all files: a copy's source may itself be generated or vendored
    entry = lean.filter("h IS NOT NULL").select("file_id", "h").distinct().join(judged.select("file_id", "repo", "mtime", "kind"), "file_id")
    entry = checkpoint(entry)
    owner = entry.groupBy("h").agg(F.count("*").alias("df"), F.min(F.struct("mtime", "file_id", "repo")).alias("o"))
    owner = owner.filter(F.col("df") >= 2).select("h", F.col("o.file_id").alias("owner"), F.col("o.repo").alias("owner_repo"))
    sizes = entry.groupBy("file_id", "repo", "mtime", "kind").agg(F.count("*").alias("size"), F.expr("bit_xor(h)").alias("x"), F.expr("bit_xor(xxhash64(h, 1))").alias("y"))
    sizes = checkpoint(sizes)
    # files of equal lines are one set, named after its oldest file; ``first`` and ``second`` are the oldest of two repositories
    holder = sizes.groupBy("size", "x", "y", "repo").agg(F.min(F.struct("mtime", "file_id", "repo")).alias("m"))
    nth = F.row_number().over(Window.partitionBy("size", "x", "y").orderBy("m"))
    sets = holder.withColumn("r", nth).filter("r <= 2").groupBy("size", "x", "y").agg(F.min("m").alias("first"), F.max("m").alias("second"))
    sets = checkpoint(sets.select(F.col("first.file_id").alias("set"), "size", "x", "y", "first", "second"))
    member = sizes.filter(F.col("kind").isNull() & (F.col("size") >= min_lines)).join(sets, ["size", "x", "y"]).select("file_id", "repo", "mtime", "size", "set", "first", "second")
    older = lambda c: F.struct(c["mtime"].alias("mtime"), c["file_id"].alias("file_id")) < F.struct("mtime", "file_id")
    source = F.when(F.col("first.repo").eqNullSafe(F.col("repo")), F.col("second")).otherwise(F.col("first"))

    def from_sets(pairs: DataFrame) -> DataFrame:
        """``file_id, owner, share`` of the files whose set is held by an older file of another repository."""
        found = pairs.withColumn("source", source)
        return found.filter(~F.col("source.repo").eqNullSafe(F.col("repo")) & older(F.col("source"))).select("file_id", F.col("source.file_id").alias("owner"), "share")

    same = from_sets(member.withColumn("share", F.lit(1.0)))
    # owners of a share of the lines that the copy may lack (at most 1 / (1 - containment) of them)
    left = checkpoint(member.join(same, "file_id", "left_anti"))
    mine = left.select("file_id", "repo", "size").join(entry.select("file_id", "h"), "file_id")
    votes = mine.join(owner, "h").filter(~F.col("repo").eqNullSafe(F.col("owner_repo"))).groupBy("file_id", "size", "owner").agg(F.count("*").alias("votes"))
    own = votes.filter(F.col("votes") >= (1 - containment) * F.col("size")).join(entry.select("file_id", "h"), "file_id")
    held = own.join(entry.select(F.col("file_id").alias("owner"), "h"), ["owner", "h"], "left_semi").groupBy("file_id", "owner").agg((F.count("*") / F.max("size")).alias("share"))
    star = checkpoint(held.filter(F.col("share") >= containment))
    # what is still open, exactly: a set that holds the share holds one of the rarest lines, size - share + 1 of them
    left = checkpoint(left.join(star, "file_id", "left_anti"))
    line = entry.join(sets.select(F.col("set").alias("file_id")), "file_id", "left_semi").select(F.col("file_id").alias("set"), "h")
    shared = line.groupBy("h").agg(F.count("*").alias("df")).filter("df >= 2")
    newest = left.groupBy("set", "size").agg(F.max(F.struct("mtime", "file_id")).alias("newest"))
    ranked = line.join(newest, "set").join(shared, "h")
    # lines of no other set are the rarest, so the others rank after them
    by_set = Window.partitionBy("set")
    alone = F.col("size") - F.count("*").over(by_set)
    place = F.row_number().over(by_set.orderBy("df", "h"))
    least = F.floor(F.lit(containment) * F.col("size"))
    prefix = ranked.select("set", "size", "newest", "h", (place + alone).alias("r")).filter(F.col("r") <= F.col("size") - least + 1)
    other = line.join(sets.select("set", F.col("size").alias("other_size"), F.struct("first.mtime", "first.file_id").alias("age")), "set").select(F.col("set").alias("other"), "h", "other_size", "age")
    near = prefix.join(other, "h").filter((F.col("set") != F.col("other")) & (F.col("other_size") >= least) & (F.col("age") < F.col("newest"))).select("set", "size", "other").distinct()
    both = near.join(line, "set").join(line.select(F.col("set").alias("other"), "h"), ["other", "h"], "left_semi").groupBy("set", "other").agg((F.count("*") / F.max("size")).alias("share"))
    both = both.filter(F.col("share") >= containment).join(sets.select(F.col("set").alias("other"), "first", "second"), "other")
    exact = from_sets(left.select("file_id", "repo", "mtime", "set").join(both, "set"))
    best = same.unionByName(star.select("file_id", "owner", "share")).unionByName(exact).groupBy("file_id").agg(F.max(F.struct("share", (-F.col("owner")).alias("o"), "owner")).alias("b"))
    copied = best.select("file_id", F.col("b.owner").alias("copied_from"), F.round("b.share", 6).alias("share"))
    out = judged.select("file_id", "kind").join(copied, "file_id", "left").withColumn("kind", F.coalesce("kind", F.when(F.col("share").isNotNull(), F.lit("copied"))))
    return out.filter("kind IS NOT NULL").select("file_id", "kind", "copied_from", "share")


def p3_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The files that no one wrote by hand, with the reason."""
    return classify(table(spark, folder, "files"), table(spark, folder, "source_lines"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The files that no one wrote by hand."""
    return p3_kinds(spark, folder).select("file_id")


QUERIES = {"p3_found": p3_found, "p3_kinds": p3_kinds}
SQL: dict[str, str] = {}
