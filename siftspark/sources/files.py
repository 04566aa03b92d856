"""Small files in the store that the session's Hadoop configuration names: local disk, HDFS or an object store."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return bool(fs.exists(p))


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if it is not there."""
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def find(spark: SparkSession, root: str, name: str) -> list[str]:
    """The paths, relative to ``root``, of the files of one name below it, hidden ones too."""
    fs, p = _path(spark, root)
    base, out, found = str(fs.makeQualified(p)).rstrip("/") + "/", [], fs.listFiles(p, True)
    while found.hasNext():
        f = found.next().getPath()
        if f.getName() == name:
            out.append(str(f)[len(base) :])
    return sorted(out)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return str(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace the file as a whole: a draft beside it is renamed over it where the store can do so."""
    draft = f"{path}.{uuid.uuid4().hex}"
    fs, d = _path(spark, draft)
    out = fs.create(d, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    jvm, (_, p) = spark._jvm, _path(spark, path)
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(d), fs.makeQualified(p), over)


def move(spark: SparkSession, old: str, new: str) -> None:
    fs, a = _path(spark, old)
    if not fs.rename(a, _path(spark, new)[1]):
        raise OSError(f"{old} cannot be moved to {new}")


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)
