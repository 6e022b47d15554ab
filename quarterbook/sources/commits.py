"""Commits by name: of several writers that claim one, one gets it."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed what this one built on; nothing of this one's is visible."""


def _place(spark: SparkSession, path: str):
    jvm = spark._jvm
    where, conf = jvm.org.apache.hadoop.fs.Path(path), spark._jsparkSession.sessionState().newHadoopConf()
    return where, where.getFileSystem(conf), conf


def claimed(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a file to a name that must be free; whether it was. Needs a file system that renames without overwriting, as HDFS does."""
    jvm = spark._jvm
    (held, _, conf), (where, fs, _) = _place(spark, source), _place(spark, target)
    fs.mkdirs(where.getParent())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    plain = spark.sparkContext._gateway.new_array(kind, 1)
    plain[0] = kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf).rename(held, where, plain)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    where, fs, _ = _place(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def removed(spark: SparkSession, path: str) -> None:
    where, fs, _ = _place(spark, path)
    fs.delete(where, True)


def read(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file; None if there is none."""
    where, fs, _ = _place(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def written(spark: SparkSession, path: str, value: dict) -> None:
    """A small JSON file."""
    where, fs, _ = _place(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
