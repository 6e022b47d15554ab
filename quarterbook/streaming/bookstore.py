"""A store of filings, their rows, books and changes in versions, of which a batch replaces only the partitions it touches.

Every table is parted by version, quarter and a bucket of managers. A batch writes the partitions it touches anew, under a version of its own, and then
claims the name of log entry n, which lists them: what counts is the newest version of each partition in the log. Rows are kept with their records, as they came, and are
not written again: a partition of them has the versions since it was last written whole, and each filing says in which of them its rows are (`rows_in`). A run that breaks off, or
that finds its entry taken, has changed nothing that readers see. Readers and batches get at partitions by a join with the log, which prunes the files that are
scanned. Every tenth entry lists all partitions, so that a reader needs at most ten; of ten versions of a partition's rows what counts is written whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.calendar import shift_period
from ..operators import changes as ch
from ..operators import positions as po
from ..sources.commits import Conflict, claimed, names, read, removed, written
from ..sources.staging import RELEASE, discard, setting, staged

PARTS = ("period_end", "bucket")
LOG = "table string, period_end date, bucket int, version string, since string"
WHOLE = 10
#: Rows dealt by quarter and bucket stay where they are when joined by these and further columns.
DEALT = "spark.sql.requireAllClusterKeysForCoPartition"


@dataclass(frozen=True)
class BookStore:
    """root: a folder that all see; buckets: of managers in each quarter, the same for the whole life of a store."""

    root: str
    buckets: int = 64

    def versions(self, spark: SparkSession) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names(spark, f"{self.root}/log") if n.endswith(".json")]

    def tags(self, spark: SparkSession) -> set[str]:
        """Batches that are in the store."""
        return {n.split("~", 1)[1] for n in names(spark, f"{self.root}/batches")}

    def entries(self, spark: SparkSession, as_of: int | None = None) -> DataFrame:
        """table, period_end, bucket and the version that counts of each partition: a row for each of them, and of rows for each version that holds some."""
        known = [v for v in self.versions(spark) if as_of is None or v <= as_of]
        if not known:
            return spark.createDataFrame([], LOG)
        first = max(v for v in known if v % WHOLE == 0 or v == known[0])
        paths = [f"{self.root}/log/{v:012d}.json" for v in known if v >= first]
        return _counting(spark.read.schema(LOG).json(paths))

    def live(self, spark: SparkSession, table: str, parts: DataFrame | None = None, as_of: int | None = None) -> DataFrame | None:
        """The rows that count, of the partitions in `parts` (period_end, bucket) if that is given; None while the table is empty.

        The log has a row for each quarter and bucket, so it is broadcast; the scan reads only the folders that it names.
        """
        found = self._stored(spark, table, parts, as_of)
        if found is None or table != "rows":
            return found
        counted = self._stored(spark, "filings", parts, as_of).select(*PARTS, "accession", "rows_in")
        return found.join(counted, [*PARTS, "accession", "rows_in"]).select("accession", "cik", *PARTS, F.inline("rows"))

    def _stored(self, spark: SparkSession, table: str, parts: DataFrame | None = None, as_of: int | None = None) -> DataFrame | None:
        """As live(); of rows, records of all versions that the log has, with their rows_in."""
        kind = read(spark, f"{self.root}/schemas/{table}.json")
        if kind is None:
            return None
        wanted = self.entries(spark, as_of).where((F.col("table") == table) & (F.col("version") > "")).select("version", *PARTS)
        if parts is not None:
            wanted = wanted.join(F.broadcast(parts), [*PARTS], "left_semi")
        schema = T.StructType([*T.StructType.fromJson(kind).fields, T.StructField("version", T.StringType())])
        found = spark.read.schema(schema).parquet(f"{self.root}/{table}").join(F.broadcast(wanted), ["version", *PARTS], "left_semi")
        return found.withColumnRenamed("version", "rows_in") if table == "rows" else found.drop("version")

    def _write(self, rows: DataFrame, table: str, label: str, dealt: bool = False) -> DataFrame:
        """Writes the partitions of a version, and reads them. The first version of a table says what its columns are. dealt: each partition is in one task already."""
        spark, kind = rows.sparkSession, f"{self.root}/schemas/{table}.json"
        rows = rows.select(*[c for c in rows.columns if c not in PARTS], *PARTS)
        known = read(spark, kind)
        if known is None:
            written(spark, kind, rows.schema.jsonValue())
        else:
            rows = rows.select(*[f["name"] for f in known["fields"]])
        # a task for each partition that is touched, and a file in each of them
        path = f"{self.root}/{table}/version={label}"
        with setting(spark, DEALT, "false"), setting(spark, RELEASE, "true"):
            (rows if dealt else rows.repartition(*PARTS)).write.mode("overwrite").partitionBy(*PARTS).parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    def ingest(self, records: DataFrame, tag: str) -> DataFrame:
        """Takes in a batch of records (filings, each with its `rows`) and returns cik and period_end of books to look at anew.

        Of records of one accession, in the batch or in the store, the one accepted last counts; of those accepted at once
        the one that came last, and within a batch the greatest. Books of the quarters and buckets touched are folded again from all that is there, however
        late a filing is, and changes of those and of the quarters next to them. A batch that is already in (by its tag) changes nothing. A
        filing's quarter and manager never change.
        """
        spark = records.sparkSession
        keys = records.select("cik", "period_end").distinct()
        if tag in self.tags(spark):
            return _near(keys)
        known = read(spark, f"{self.root}/schemas/rows.json")
        if known is not None and "rows" not in {f["name"] for f in known["fields"]}:
            raise ValueError(f"{self.root} was filled before rows were kept with their records; fill a new store")
        version, own = max(self.versions(spark), default=0) + 1, uuid.uuid4().hex[:12]
        whole, label = (f"{version:012d}-{k}{own}" for k in (0, 1))
        bucket = F.pmod(F.xxhash64("cik"), F.lit(self.buckets)).cast("int")

        # rows: the batch as it comes, with what its rows tell
        batch = self._write(po.judged(po.told_facts(records.withColumn("bucket", bucket))), "rows", label)
        if batch.groupBy("accession").count().where("count > 1").limit(1).count():  # filings with their rows are moved again only if one comes twice
            first = staged(batch, "batch")
            columns = ["acceptance", *[c for c in [*records.columns, *batch.columns] if c not in ("accession", "acceptance")]]
            last = first.groupBy("accession").agg(F.max(F.struct(*dict.fromkeys(columns))).alias("_r")).select("accession", "_r.*")
            batch = self._write(last, "rows", label)
            discard(first)
        parts = staged(batch.select(*PARTS).distinct(), "parts")

        # of what is there: partitions whose rows are in many versions are written whole, those of filings that count
        before, stays, lines = self.live(spark, "filings", parts), self._stored(spark, "rows", parts), parts.withColumn("since", F.lit(label))
        spent = [parts]
        if before is not None:
            found = self.entries(spark).where("table = 'rows'").groupBy(*PARTS).agg(F.min("version").alias("since"), F.count("*").alias("n"))
            found = staged(parts.join(found, [*PARTS], "left"), "found")
            crowded = found.where(F.col("n") >= WHOLE).select(*PARTS)
            lines = found.select(*PARTS, F.when(F.col("n") >= WHOLE, whole).otherwise(F.coalesce("since", F.lit(label))).alias("since"))
            spent.append(found)
            if crowded.limit(1).count():
                met = [*PARTS, "accession", "rows_in"]
                kept = self._write(stays.join(F.broadcast(crowded), [*PARTS], "left_semi").join(before.select(*met), met, "left_semi").drop("rows_in"), "rows", whole)
                stays = stays.join(F.broadcast(crowded), [*PARTS], "left_anti").unionByName(kept.withColumn("rows_in", F.lit(whole)))
                before = before.join(F.broadcast(crowded.withColumn("_whole", F.lit(whole))), [*PARTS], "left").withColumn("rows_in", F.coalesce("_whole", "rows_in")).drop("_whole")

        # filings: what is there and what comes, the last accepted of each accession
        both = batch.drop("rows").withColumn("rows_in", F.lit(label)).withColumn("_in", F.lit(True))
        if before is not None:
            both = both.unionByName(before.withColumn("_in", F.lit(False)))
        rest = [c for c in both.columns if c not in ("accession", "acceptance", "_in", *PARTS)]
        merged = both.repartition(*PARTS).groupBy(*PARTS, "accession").agg(F.max_by(F.struct("acceptance", "_in", *rest), F.struct("acceptance", "_in")).alias("_r")).select("accession", "_r.*", *PARTS)
        filings = self._write(merged.drop("_in"), "filings", label, dealt=True)

        # books of what is touched, of the records that hold the rows of their filings
        held = batch.withColumn("rows_in", F.lit(label))
        held = held if stays is None else stays.unionByName(held)
        books = self._write(po.book_of(held, filings, _tasks(filings), PARTS), "books", label, dealt=True)

        # changes of those quarters and of both neighbours, if anything is known there
        near = staged(_near(parts, "bucket"), "near")
        wide = near.unionByName(near.select(shift_period(F.col("period_end"), -1).alias("period_end"), "bucket")).distinct()
        others = staged(wide.join(parts, [*PARTS], "left_anti"), "others")
        filings, books = (now if (then := self.live(spark, table, others)) is None else then.unionByName(now) for table, now in (("filings", filings), ("books", books)))
        changing = staged(near.join(filings.select(*PARTS).distinct(), [*PARTS], "left_semi"), "changed")
        states = ch.prior_states(po.quarters(filings)).withColumn("bucket", bucket)
        changed = ch.published(ch.changes(books, states, tasks=_tasks(filings), by=PARTS), by=PARTS)
        self._write(changed.join(F.broadcast(changing), [*PARTS], "left_semi"), "changes", label, dealt=True)

        own = lambda rows: rows.withColumn("version", F.lit(label))
        both = own(lines).unionByName(lines.where(F.col("since") == whole).withColumn("version", F.lit(whole)))
        touched = {"filings": own(parts), "rows": both, "books": own(parts), "changes": own(changing)}
        self._commit(spark, version, touched, tag)
        discard(*spent, near, others, changing)
        return _near(keys)

    def _commit(self, spark: SparkSession, version: int, touched: dict[str, DataFrame], tag: str) -> None:
        """Claims log entry `version`, of the versions of partitions in `touched`; Conflict if another batch has it."""
        lines = None
        for table, parts in touched.items():
            since = F.col("since") if "since" in parts.columns else F.lit(None).cast("string")
            own = parts.select(F.lit(table).alias("table"), *PARTS, "version", since.alias("since"))
            lines = own if lines is None else lines.unionAll(own)
        if version % WHOLE == 0:
            lines = _counting(self.entries(spark).unionByName(lines))
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}"
        lines.coalesce(1).write.json(draft)  # a line for each partition
        [part] = [n for n in names(spark, draft) if n.startswith("part-")]
        taken = not claimed(spark, f"{draft}/{part}", f"{self.root}/log/{version:012d}.json")
        removed(spark, draft)
        if taken:
            raise Conflict(f"version {version} of {self.root} was committed by another batch")
        written(spark, f"{self.root}/batches/{version:012d}~{tag}", {"version": version})

    def vacuum(self, spark: SparkSession) -> list[str]:
        """Deletes folders of partitions that no longer count, and returns them. Nobody may be reading older versions."""
        gone = []
        counts = {(r.table, str(r.period_end), r.bucket, r.version) for r in self.entries(spark).collect()}  # a row for each partition
        for table in ("filings", "rows", "books", "changes"):
            for version in [n for n in names(spark, f"{self.root}/{table}") if n.startswith("version=")]:
                for quarter in [n for n in names(spark, f"{self.root}/{table}/{version}") if "=" in n]:
                    for bucket in [n for n in names(spark, f"{self.root}/{table}/{version}/{quarter}") if "=" in n]:
                        key = (table, quarter.split("=")[1], int(bucket.split("=")[1]), version.split("=")[1])
                        if key not in counts:
                            gone.append(f"{self.root}/{table}/{version}/{quarter}/{bucket}")
                            removed(spark, gone[-1])
        return gone


def _tasks(filings: DataFrame) -> int:
    """By the rows of filings; not fewer than Spark would take by itself, as it deals anew, by all keys of a join, what is in fewer."""
    return max(po.parts(filings), int(filings.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _counting(log: DataFrame) -> DataFrame:
    """Of lines of the log those that count: of each partition those from `since` of its newest line on, or that line alone."""
    part = Window.partitionBy("table", *PARTS)
    first = F.max_by(F.coalesce("since", "version"), "version").over(part)
    return log.withColumn("_first", first).where("version >= _first").drop("_first")


def _judged(batch: DataFrame) -> DataFrame:
    """Filings of a batch of records, with what their rows tell."""
    return po.judged(po.told_facts(batch)).drop("rows")


def _near(keys: DataFrame, other: str = "cik") -> DataFrame:
    """The quarters of keys and both neighbours."""
    moved = F.explode(F.array(F.col("period_end"), shift_period(F.col("period_end"), 1), shift_period(F.col("period_end"), -1)))
    return keys.select(other, moved.alias("period_end")).distinct()


def record_type(row: T.StructType) -> T.StructType:
    """The least that a record has; further columns of filings stay with them."""
    kinds = {"accession": "string", "cik": "string", "period_end": "date", "acceptance": "timestamp", "is_amendment": "boolean", "amendment_type": "string", "schema_version": "string", "is_notice": "boolean", "table_value_total": "bigint", "confidential_omitted": "boolean"}
    fields = [T.StructField(n, T._parse_datatype_string(k)) for n, k in kinds.items()]
    return T.StructType([*fields, T.StructField("rows", T.ArrayType(row))])
