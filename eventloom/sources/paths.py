"""Folder checks through the file system Spark itself uses."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return bool(fs.exists(target))


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def folder_of_row() -> Column:
    """The folder of the file a row was read from, as Spark lists it; valid right after a read."""
    return F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*\\z", "")


def delete_folders(folders: DataFrame, top: str) -> None:
    """Removes the listed folders (column ``folder``, from ``folder_of_row``) below ``top``.

    Only folders Spark found itself are named here, never paths put together from values,
    which clients choose; what does not lie below ``top`` is refused.
    """
    spark = folders.sparkSession
    fs, root = _file_system(spark, top)
    inside = fs.makeQualified(root).toUri().getPath().rstrip("/") + "/"
    for row in folders.select("folder").distinct().toLocalIterator():
        target = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(row.folder))
        if not target.toUri().getPath().startswith(inside):
            raise ValueError(f"{row.folder} is not below {top}")
        fs.delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the data folders directly below ``path``."""
    fs, target = _file_system(spark, path)
    names = [status.getPath().getName() for status in fs.listStatus(target)]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def plain_path(spark: SparkSession, path: str) -> str:
    """The path without scheme and host, absolute."""
    fs, target = _file_system(spark, path)
    return str(fs.makeQualified(target).toUri().getPath())


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _file_system(spark, path)
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that must not exist yet; it appears whole, by a rename."""
    fs, target = _file_system(spark, path)
    jvm = spark._jvm
    draft = jvm.org.apache.hadoop.fs.Path(f"{target.getParent()}/.{target.getName()}-{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
    except Py4JJavaError as problem:
        fs.delete(draft, False)
        if fs.exists(target):
            raise FileExistsError(path) from problem
        raise
