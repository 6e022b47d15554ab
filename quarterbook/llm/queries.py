"""The queries of this subpackage: each applies its operator to a whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, key_crc, read_table, slices, staged, words_of
from .collocations import collocations
from .decontamination import contamination
from .jaccard_join import similar_components
from .kd_sharding import kd_shards
from .language_id import identify
from .packing import best_fit_pack
from .periodic_runs import periodic_runs
from .quality import score_quality
from .secret_scan import BASE, scan_secrets
from .sentence_pieces import encode_decode
from .substring_dedup import repeated_passages
from .telephony import CODECS, decode_audio, features, store_audio
from .voronoi_knn import top_k

RANKS = "byte_bpe_50k.tiktoken"  # the ids of byte_bpe_50k.json, in the form that tiktoken reads
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE]
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, base), F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op3_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = staged(store_audio(read_table(spark, sf_dir, "documents")), "media")
    found = []
    for codec in CODECS:  # PCM takes several times the room of the files: that of one codec at a time
        audio = staged(decode_audio(stored.where(F.col("codec") == codec), keep=("n_bytes",)), "pcm")
        found.append(staged(features(audio), "features"))
        discard(audio)
    return reduce(DataFrame.unionAll, found).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(read_table(spark, sf_dir, "documents"), tokenizer_path(RANKS), length=2048, end_id=0, payload="crc32")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(read_table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), threshold=0.7)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(key_crc(), F.lit(3)) == 1
    return identify(read_table(spark, sf_dir, "documents"), training=~held_out, keep={"held_out": held_out})


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kd_shards(read_table(spark, sf_dir, "documents"), shards=24)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), tokenizer_path(PIECES), output="sha256")


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; of a tenth of the ids, by crc32 h of the id, the words from a = g % n on are those of a stretch of p, again and again, with g = h // 10 and p = 1 + (n - a) // (3 + g % 8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text, h in zip(batch.column("text").to_pylist(), batch.column("h").to_pylist(), strict=True):
                words = words_of(text) if h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    text = b" ".join([*words[:a], *(words[a + k % p] for k in range(n - a))]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    rows = docs.select("doc_id", F.col("text"), key_crc().alias("h"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(read_table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    exponent = F.expr("best.length * 1000 div best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"), least=10, percent=50, most=2000)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_substring_dedup, op2_secret_scans, op3_telephony_audio, op4_best_fit_packing, op5_ngram_jaccard_join, op6_exact_top_k, op7_quality_classifier, op8_language_id, op9_kd_sharding, op10_sentencepiece, op11_periodic_runs, op12_collocations, op13_decontamination)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
