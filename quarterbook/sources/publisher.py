"""Publishing of artifacts: those that haven't changed aren't written again, what is written is checked on its way, and the pointer comes last.

A listing has a row for each artifact: its key, size, digest, the build in whose folder it lies, and its file there. A build writes the artifacts
whose size or digest differ, and a listing of all. So a build costs what has changed, and readers go from the pointer to the listing to the file.

Up to MOST_FILES artifacts get a file each. Of more, those whose keys hash alike share one, a line for each: what a file costs to create, move and
list is many times what an artifact of some KB does. A file holds about BYTES_A_FILE at most, so large builds get more of them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .commits import read, written
from .snapshots import current_build, optional, point, pointer
from .staging import discard, staged

LISTING = "key string, size long, digest string, build string, file string"
MOST_PRUNED, SHARE_PRUNED = 100, 0.5
MOST_FILES, BYTES_A_FILE = 500, 64 << 20


class Refused(ValueError):
    """A build that must not become the current one."""


def listing(spark: SparkSession, root: str, build: str | None = None) -> DataFrame:
    """Of a build, the current one unless another is named: where each artifact lies. Empty before the first build."""
    build = build or current_build(spark, root)
    return optional(spark, f"{root}/listings/{build}", LISTING)


def file_of(artifacts: int, size: int) -> Column:
    """The file of a key, in a build that writes so many artifacts of so many bytes."""
    files = max(MOST_FILES, -(-size // BYTES_A_FILE))
    return F.col("key") if artifacts <= files else F.pmod(F.xxhash64("key"), F.lit(files)).cast("string")


def publish_artifacts(artifacts: DataFrame, root: str, build: str, expect: Mapping[str, Column] | None = None, fewest: int = 1, prune: bool = False, after: int | None = None) -> dict[str, int]:
    """Publishes artifacts (key, body: one line of text; other columns only for `expect`); returns how many there are, were written, stay, and were pruned.

    `expect` names conditions that hold for every artifact. They are counted while the listing is written, in the same pass, as are keys
    that come twice, null bodies and bodies of several lines; if any fails, or there are fewer than `fewest` artifacts, the build is Refused and the pointer stays where it is. Artifacts of the build
    before that this one lacks are kept, unless `prune`; more than 100 of them that are more than half of all are never pruned at once. If
    another build has followed pointer `after` (the newest at the start), this one is a Conflict.
    """
    spark = artifacts.sparkSession
    after = pointer(spark, root) if after is None else after
    before = staged(listing(spark, root, read(spark, f"{root}/pointer/{after:012d}.json")["build"]) if after else spark.createDataFrame([], LISTING), "before")
    told = {"artifacts": F.count("*"), "null": F.count_if(F.col("body").isNull()), "of several lines": F.count_if(F.contains("body", F.lit("\n"))), **{f"not {name}": F.count_if(~F.coalesce(holds, F.lit(False))) for name, holds in (expect or {}).items()}}
    seen = Observation()
    sized = artifacts.withColumn("size", F.octet_length(F.col("body").cast("binary")).cast("long")).withColumn("digest", F.sha2("body", 256)).observe(seen, *[c.alias(n) for n, c in told.items()])
    sized = staged(sized.select("key", "body", "size", "digest"), "artifacts")
    faults = {n: v for n, v in seen.get.items() if n != "artifacts" and v}
    total = seen.get["artifacts"]
    same = before.select("key", "size", "digest", F.col("build").alias("_held"), "file")
    both = sized.select("key", "size", "digest").join(same, ["key", "size", "digest"], "left")
    placed = both.select("key", "size", "digest", F.coalesce("_held", F.lit(build)).alias("build"), "file")
    lost = before.join(sized.select("key"), "key", "left_anti")
    counted = Observation()
    kinds = [F.count_if(F.col("build") == build).alias("written"), F.coalesce(F.sum(F.when(F.col("build") == build, F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(F.col("_lost")).alias("lost"), F.count("*").alias("all")]
    rows = placed.withColumn("_lost", F.lit(False)).unionByName(lost.withColumn("_lost", F.lit(True)))
    new = staged(rows.observe(counted, *kinds), "listing")
    twice = sized.groupBy("key").count().where("count > 1").limit(1).count()
    if twice:
        faults["key comes twice"] = twice
    if total < fewest:
        faults["artifacts"] = total
    gone, every = counted.get["lost"], counted.get["all"]
    if prune and gone > MOST_PRUNED and gone > SHARE_PRUNED * every:
        faults["pruned"] = gone
    if faults:
        discard(before, sized, new)
        raise Refused(f"build {build}: {faults}")
    here, file = (F.col("build") == build) & ~F.col("_lost"), file_of(counted.get["written"], counted.get["bytes"])
    changed = sized.join(new.where(here).select("key"), "key", "left_semi")
    lines = changed.select(F.concat(F.url_encode("key"), F.lit("\t"), "body").alias("value"), file.alias("file"))
    lines.repartition("file").write.mode("overwrite").partitionBy("file").option("lineSep", "\n").text(f"{root}/files/build={build}")
    (new.where(~F.col("_lost")) if prune else new).withColumn("file", F.when(here, file).otherwise(F.col("file"))).drop("_lost").write.mode("overwrite").parquet(f"{root}/listings/{build}")
    written(spark, f"{root}/builds/{build}.json", {"build": build, "artifacts": total, "after": after})
    point(spark, root, build, after)
    discard(before, sized, new)
    return {"artifacts": total, "written": counted.get["written"], "kept": total - counted.get["written"], "lost": gone, "pruned": gone if prune else 0}


def bodies(spark: SparkSession, root: str, keys: DataFrame | None = None) -> DataFrame:
    """key and body of the current build's artifacts, of `keys` (key) if given. Files are found by build and file, which are folders."""
    held = listing(spark, root)
    if keys is not None:
        held = held.join(keys.select("key"), "key", "left_semi")
    lines = optional(spark, f"{root}/files", "value string, build string, file string", "text", lineSep="\n")
    end = F.instr("value", "\t")
    told = lines.select("build", "file", F.url_decode(F.substr("value", F.lit(1), end - 1)).alias("key"), F.substr("value", end + 1).alias("body"))
    return told.join(held.select("build", "file", "key"), ["build", "file", "key"]).select("key", "body")


def artifact(spark: SparkSession, root: str, key: str) -> str | None:
    """One artifact as its build wrote it; None if the current build has none of that key."""
    row = bodies(spark, root, spark.createDataFrame([(key,)], "key string")).first()
    return row and row["body"]
