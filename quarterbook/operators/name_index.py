"""A stored index of names and tickers by their letters: a search reads the few buckets that hold its grams, not every name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SIZES = (1, 2, 3)
BUCKETS = 64


def _bucket(spark: SparkSession, grams: list[str]) -> list[int]:
    """Buckets of grams, as the writer gives them."""
    rows = spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.hash("gram"), F.lit(BUCKETS)).alias("b")).collect()
    return sorted({r.b for r in rows})


def write_index(filers: DataFrame, path: str, columns: tuple[str, ...] = ("name", "ticker")) -> None:
    """Stores a row for each key (cik) and gram of one to three letters of a field, in lower case, in folders by a hash of the gram. filers: cik and the fields."""
    fields = [F.lower(F.col(c)) for c in columns if c in filers.columns]
    text = filers.select("cik", F.explode(F.array_compact(F.array(*fields))).alias("t"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length("t") - n + 1), lambda i: F.substring(F.col("t"), i, F.lit(n)))
    every = F.array_distinct(F.concat(*[F.when(F.length("t") >= n, grams(n)).otherwise(F.array().cast("array<string>")) for n in SIZES]))
    postings = text.select("cik", F.explode(every).alias("gram")).distinct().withColumn("bucket", F.pmod(F.hash("gram"), F.lit(BUCKETS)))
    postings.repartition("bucket").sortWithinPartitions("gram", "cik").write.mode("overwrite").partitionBy("bucket").parquet(path)


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame:
    """cik of rows that hold all grams of a text: all that contain it, and some that don't. Only folders and row groups of its grams are read."""
    wanted = text.lower()
    size = min(len(wanted), SIZES[-1])
    grams = sorted({wanted[k : k + size] for k in range(len(wanted) - size + 1)})
    postings = spark.read.schema("cik string, gram string, bucket int").parquet(path)
    met = postings.where(F.col("bucket").isin(_bucket(spark, grams)) & F.col("gram").isin(grams))
    return met.groupBy("cik").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("cik")


def search(filers: DataFrame, path: str, text: str, columns: tuple[str, ...] = ("name", "ticker"), most: int = 100) -> DataFrame:
    """The first `most` filers of which a field contains the text, in any case, with their place: those of which one begins with it come first, then by name and cik. An empty text finds all."""
    spark = filers.sparkSession
    found = filers.join(candidates(spark, path, text), "cik", "left_semi") if text else filers
    fields, wanted = [F.coalesce(F.lower(F.col(c)), F.lit("")) for c in columns if c in filers.columns], F.lit(text.lower())
    any_of = lambda test: F.greatest(*[test(f, wanted).cast("int") for f in fields], F.lit(0))
    held = found.where(any_of(F.contains) == 1).withColumn("_first", 1 - any_of(F.startswith))
    top = held.orderBy("_first", "name", "cik").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy("_first", "name", "cik"))).drop("_first")  # `most` rows
