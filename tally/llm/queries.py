"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm import fingerprints, html_extract, lattice_sampling, license_scan, minhash_dedup, packing, quality_pu, secret_scan, simhash_dedup, source_divergence, url_filter, vafile_topk, whitening

URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def _table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def op10_url_filter(spark: SparkSession, data_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, data_dir, "pages"), URL_RULES, keep=["page_id"])


def op1_near_dedup(spark: SparkSession, data_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, data_dir, "documents"), size=2)


def op2_vafile_topk(spark: SparkSession, data_dir: str) -> DataFrame:
    return vafile_topk.topk(_table(spark, data_dir, "embeddings"))


def op3_lattice_sampling(spark: SparkSession, data_dir: str) -> DataFrame:
    """Two distinct segmentations of every document, decoded again."""
    model = tokenizer_path("piece_bpe_32k.model")
    drawn = lattice_sampling.sample_segmentations(_table(spark, data_dir, "documents"), model, k=2)
    drawn = drawn.withColumns({"n_pieces": F.size("ids").cast("long"), "ids_hash": F.xxhash64("ids")})
    return (lattice_sampling.decode(drawn, model)
            .select("doc_id", "sample", "n_pieces", "ids_hash", "log_prob", "log_inclusion",
                    F.length("text").cast("long").alias("decoded_chars"),
                    F.crc32(F.encode("text", "UTF-8")).alias("decoded_crc32")))


def op4_secret_scan(spark: SparkSession, data_dir: str) -> DataFrame:
    """A document is its own repository; its source owns it."""
    return secret_scan.scan_secrets(_table(spark, data_dir, "documents"))


def op5_quality(spark: SparkSession, data_dir: str) -> DataFrame:
    return quality_pu.score_documents(_table(spark, data_dir, "documents"), _table(spark, data_dir, "labels"))


def op6_html_extract(spark: SparkSession, data_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, data_dir, "pages"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, data_dir: str) -> DataFrame:
    """The pieces' places and checksums; the ids themselves are columns of ``pack`` and of the pipeline's output."""
    return packing.pack(_table(spark, data_dir, "documents"), tokenizer_path()).drop("ids")


def op9_fingerprints(spark: SparkSession, data_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, data_dir, "documents"))


def op8_license_scan(spark: SparkSession, data_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, data_dir, "documents")).drop("detections")


def op11_simhash_dedup(spark: SparkSession, data_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, data_dir, "documents"))


def op12_source_divergence(spark: SparkSession, data_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, data_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, data_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, data_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_vafile_topk": op2_vafile_topk,
    "op3_lattice_sampling": op3_lattice_sampling,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality": op5_quality,
    "op6_html_extract": op6_html_extract,
    "op7_packing": op7_packing,
    "op9_fingerprints": op9_fingerprints,
    "op8_license_scan": op8_license_scan,
    "op10_url_filter": op10_url_filter,
    "op11_simhash_dedup": op11_simhash_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_embedding_whitening": op13_embedding_whitening,
}
