"""Published snapshots: each build has a folder of its own, and a numbered pointer that is claimed last says which one counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .commits import Conflict, claimed, names, read, removed, written


def pointer(spark: SparkSession, root: str) -> int:
    """The number of the newest pointer; 0 before the first."""
    return max((int(n.removesuffix(".json")) for n in names(spark, f"{root}/pointer") if n.endswith(".json")), default=0)


def point(spark: SparkSession, root: str, build: str, after: int) -> int:
    """Makes a build the current one, if pointer `after` is still the newest; Conflict if somebody else has published meanwhile."""
    draft, number = f"{root}/drafts/{uuid.uuid4().hex}.json", after + 1
    written(spark, draft, {"build": build})
    if pointer(spark, root) != after or not claimed(spark, draft, f"{root}/pointer/{number:012d}.json"):
        removed(spark, draft)
        raise Conflict(f"build {build} follows pointer {after} of {root}, which is no longer the newest")
    return number


def publish(tables: dict[str, DataFrame], root: str, build: str, after: int | None = None) -> int:
    """Writes every table of a build, and then the pointer: a run that breaks off, or that isn't the first to follow pointer `after` (the newest at the start), leaves the build before it in place."""
    spark = next(iter(tables.values())).sparkSession
    after = pointer(spark, root) if after is None else after
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{root}/builds/{build}/{name}")
    return point(spark, root, build, after)


def current_build(spark: SparkSession, root: str) -> str | None:
    """The build that was published last; None before the first."""
    number = pointer(spark, root)
    return read(spark, f"{root}/pointer/{number:012d}.json")["build"] if number else None


def load(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table of the current build; a table that it doesn't have is empty."""
    return optional(spark, f"{root}/builds/{current_build(spark, root)}/{name}", schema)


def optional(spark: SparkSession, path: str, schema: str, form: str = "parquet", **options: str) -> DataFrame:
    """What is stored at a path, or no rows where nothing is: that is an answer, not an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return spark.read.schema(schema).format(form).options(**options).load(path)
    return spark.createDataFrame([], schema)


def first_of(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of several places that holds anything."""
    for path in paths:
        found = optional(spark, path, schema)
        if found.inputFiles():
            return found
    return spark.createDataFrame([], schema)
