"""Tables written once in the folder that driver and executors share, and read from there by the rest of a plan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a query go when it ends, rather than when its DataFrame is no longer held.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session gets a temporary folder of its own; a cluster, which has none that all see, an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="quarterbook-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the writes within."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read from there: cuts lineage, and survives lost executors.

    Once the table is written, nothing needs the shuffles that led to it: their files are released. Releasing only
    bears on the query that ends, so another query of the session that runs meanwhile gives the same rows either way.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with setting(spark, RELEASE, "true"):
        df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(place)  # with the driver, if not discarded before
    held = spark.read.schema(df.schema).parquet(path)
    held._staged = path
    return held


_KEPT: dict[tuple[str, str], DataFrame] = {}


def staged_once(spark: SparkSession, label: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """staged(make()), made once for each application and source; again if somebody has cleared the folder."""
    key = (f"{spark.sparkContext.applicationId} {label}", source)
    held = _KEPT.get(key)
    if held is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(held._staged)
        if place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
            return held
    _KEPT[key] = staged(make(), label)
    return _KEPT[key]


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no plan still to run reads; others are left alone."""
    for table in tables:
        path = getattr(table, "_staged", None)
        if path is not None:
            jvm = table.sparkSession._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
