"""From documents to training tokens: five stages, each a DataFrame of documents to the next.

Toxic documents go; one document of each group of near copies stays (five-word shingles, similarity 0.8); passages of 200 bytes that
repeat are cut out of the texts; the sources are mixed to their target weights in training order, some documents
several times; the texts become token ids. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataweft.llm import byte_bpe, mixing, parity_join, substrings, toxicity
from dataweft.llm.common import crc_mod, table
from dataweft.session import work_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't call toxic; labels of a fifth of the ids are never learnt from."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod(5) != 0)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return toxicity.score(rows, model, ["row"], "row.text").where("predicted = 0").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group that links of similarity 0.8 or more connect: that of the least id, rows without an id last, then by hashes of all columns.

    Rows equal in all columns are one document; others without words stay. Texts that share an id are documents of their own.
    """
    whole = F.struct(*docs.columns)
    key = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.xxhash64(whole).alias("h"), F.xxhash64(whole, F.lit(1)).alias("g"))
    groups = parity_join.components(docs.select(key.alias("doc_id"), "text"), words=5, percent=80)
    stay = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias("key")).distinct()
    return docs.select(whole.alias("row"), key.alias("key")).join(stay, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 200 bytes that occur elsewhere; no document goes, a NULL text stays NULL."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    cleaned = substrings.remove_repeats(rows, keep=("row",), texts_too=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept_text"))
    return cleaned.withColumn("text", text).select(*[
        F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, in training order."""
    return mixing.training_order(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids_sha256, decoded_sha256, ids) of every copy."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep=("doc_id", "source"), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard_join", drop_near_copies), ("suffix_array_dedup", cut_repeats),
          ("source_mixing", mix_sources), ("byte_bpe", tokenise)]

#: The toxicity model, the merges and the suffix sort have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = work_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
