"""What the operators share: Arrow slices, words, numbering within groups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import discard, staged

__all__ = ["arrow_rows", "discard", "hot_join", "hot_keys", "key_crc", "ranked", "read_table", "slices", "staged", "words_of"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose column holds about `most` bytes, of `rows` rows at most; one longer value stands alone."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, n in enumerate(sizes):
            if i > start and (held + n > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() parts at just these six characters."""
    return text.encode().split() if text else []


def arrow_rows(rows: Sequence[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def key_crc(column: str = "doc_id"):
    """crc32 of an id written as text (a null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str) -> DataFrame:
    """Adds `rank`, gapless from 0 within each group, without bringing a group into one task.

    Rows are dealt to buckets by a hash of `order`; a running sum over the bucket counts (groups times
    buckets rows, however many rows there are) gives each bucket its first rank, and only the rows of one
    bucket are sorted together. The number of buckets follows spark.sql.shuffle.partitions.
    """
    buckets = max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    keys = [*group, "_bucket"]
    within = Window.partitionBy(*group).orderBy("_bucket")
    first = (
        held.groupBy(*keys).agg(F.count("*").alias("_n"))
        .withColumn("_first", F.sum("_n").over(within) - F.col("_n")).drop("_n")
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = held.withColumn("_row", F.row_number().over(inside))
    return numbered.join(first, keys).withColumn(rank, (F.col("_first") + F.col("_row") - 1).cast("long")).drop("_bucket", "_first", "_row")


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """keys and _copies of the keys that hold more than a thousandth of the rows counted in `counts`: fewer than a thousand, whatever the corpus."""
    total = counts.agg(F.sum(n)).first()[0] or 1
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counts.where(F.col(n) * 1000 > total).select(*keys, F.ceil(F.col(n) * partitions / F.lit(total)).cast("int").alias("_copies"))


def hot_join(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """many.join(one, keys), with the rows of `many` under a hot key dealt, by a hash of `by`, over copies of that key's rows in `one`; so are those under a null key."""
    partitions = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 1
    copies = F.when(none, F.lit(partitions)).otherwise(F.coalesce("_copies", F.lit(1)))
    dealt = many.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), copies).cast("int")).drop("_copies")
    copied = one.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")
