"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm import minhash_dedup, packing, quality_pu, secret_scan
from tally.llm.common import session_partitions, written
from tally.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # columns of any name stay apart from the scores
    scored = quality_pu.score_documents(docs.select("doc_id", "text", whole.alias("document")), labels, keep=["document"])
    return scored.where("predicted = 1").select("document.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: five-word shingles, similarity 0.8 or more.

    The document of a group's least id stays; of rows that share id and text one stays, of
    rows that share the id alone each is a document of its own; documents without an id stay.
    """
    own = F.coalesce(F.sha2("text", 256), F.lit(""))
    n = session_partitions(spark)
    # sorted by id, then text: the nodes ascend with the ids
    named = written(docs.where("doc_id is not null").withColumn("__digest", own)
                    .repartitionByRange(n, "doc_id", "__digest").dropDuplicates(["doc_id", "__digest"])
                    .sortWithinPartitions("doc_id", "__digest")
                    .withColumn("__node", F.monotonically_increasing_id()).drop("__digest"))
    judged = minhash_dedup.near_duplicates(named, id_col="__node", size=5)
    single = named.join(judged.where("kept").select("__node"), "__node", "left_semi")
    return single.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask live-looking credentials; copied examples and all documents stay."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, in document order, with their token ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each works on all that its predecessor kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
