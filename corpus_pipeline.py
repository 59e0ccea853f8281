"""The corpus pipeline: quality rules, near-duplicate removal, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents. Every stage takes null and repeated ids, null and empty texts, texts of any
length, extra columns (they stay, whatever their names, up to the last stage) and a table without rows, which gives none; how each is judged stands with its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    A null or empty text is rejected, as it has too few words. Rows that share a doc_id stay together if the rules keep any of them; rows
    without an id count as sharing one. A measure equal to its cutoff is rejected.
    """
    from sightline.llm.common import small
    from sightline.llm.quality import quality_verdicts

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdicts = quality_verdicts(docs.select("doc_id", "lang", "text"), labels)
    rejected = verdicts.groupBy("doc_id").agg(F.max("kept").alias("any")).where("not any").select(F.col("doc_id").alias("_rejected"))
    rejected = small(rejected)
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["_rejected"]), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their shingles of five words, the one with the smallest doc_id stays.

    Documents without words are no one's duplicates. Rows that share a doc_id stay or go together; rows without an id stay.
    """
    from sightline.llm.ngram_join import keep_one_of_each_group

    return keep_one_of_each_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and revealing terms are replaced in the texts; n_chars follows (null for a null text). No row goes.

    A term that ties between both actions is removed.
    """
    from sightline.llm.pii import sanitised

    clean = sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken, once at most, to the target weights, in a seeded order within a source.

    Rows that share a doc_id, or have none, are taken or left together; a text without words goes with the prefix that it stands in.
    """
    from sightline.llm.mixing import mixed_documents

    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; each row is packed, a null or empty text as its end token alone.

    Texts of any length are cut into pieces; pieces of equal length lie in the order of doc_id and start.
    """
    import public_tokenizers

    from sightline.llm.packing import pack

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: The binomial bounds, the tokenizer and the hash orders have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two of them goes to the shared checkpoint folder."""
    from sightline.sources.scratch import shared_folder

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
