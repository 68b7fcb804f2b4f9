"""A training-corpus pipeline over ``documents``.

Language ID, near-duplicate removal, repeated-passage removal, benchmark decontamination, then
byte-level BPE encoding. Each stage works on all rows its predecessor kept; its result is written as
Parquet to the shared folder and read again by the next one.

Cases that hold for every stage: null or empty texts are of no language and go with the first stage;
rows with a null doc_id are never duplicates; rows that repeat a doc_id stay or go together; extra
columns of ``documents`` are carried along; an empty table gives empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import bpe_fst, decontaminate, language_crf, ngram_join, substring_dedup
from wardlight.llm.common import read_table
from wardlight.session import scratch_path

MIN_LANGUAGE_SCORE = 0.5   # a document's words are of its language on the average at least so surely


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that have letters and one language for at least half of their words."""
    others = [c for c in docs.columns if c != "text"]
    found = language_crf.label_documents(docs, language_crf.train(docs), others, with_text=True)
    sure = (F.col("lang_pred") != language_crf.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.where(sure).select(*["text" if c == "text" else F.col("carried")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates."""
    groups = ngram_join.near_duplicates(docs)
    copies = groups.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that start in an earlier document too; the rest of the text stays as it is."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = substring_dedup.remove_repeats(docs, carried=others, layout=True)
    made = {"text": F.col("kept").alias("text"), "n_chars": F.length("kept").cast("long").alias("n_chars")}
    return rows.select(*[made.get(c, F.col("carried")[c].alias(c)) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, up to its error budget."""
    return decontaminate.without_items(docs, read_table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and digests of the ids and the text
    decoded from them."""
    rows = bpe_fst.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), "ids",
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("decontamination", decontamination), ("token_ids", token_ids)]

# A random field, count-min sketches and a transducer have no SQL form: tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
