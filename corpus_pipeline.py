"""The documents' way to training tokens: five stages over the training-data operators.

Every stage works on the rows that its predecessor kept and its decisions take effect; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import attention_mil, chunk_bpe, circulant_minhash, fm_index, line_rules
from docflow.llm.common import read, saved
from docflow.session import ensure_checkpoint_dir

QUALITY = 0.7
TOKENIZER = "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below ``QUALITY`` go."""
    model = attention_mil.train(docs, read(spark, sf_dir, "labels"))
    rest = [c for c in docs.columns if c != "text"]
    scored = docs.select(F.struct(*rest).alias("doc"), F.col("text"))  # the text crosses once
    good = attention_mil.score(scored, model).where(F.col("score") >= QUALITY)
    return good.select(*(F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted of their own lines go."""
    return line_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 80 %) the smallest id stays; rows
    that share an id and belong to one group stay once."""
    found = circulant_minhash.near_duplicates(docs, shingle=5, percent=80)
    ids = found.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.every("kept").alias("kept"), F.count("*").alias("rows"))
    ids = saved(ids.where(~F.col("kept") | (F.col("rows") > 1)), "copies")
    out = docs.join(ids, docs["doc_id"] == ids["id"], "left_anti")
    twice = ids.where("kept").select("id")
    if twice.isEmpty():
        return out
    again = docs.join(twice, docs["doc_id"] == twice["id"], "left_semi")
    once = again.groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("doc")).select("doc.*")
    return out.unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents without a word left go."""
    return fm_index.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of the whole text, their number, and the text decoded again."""
    spec = chunk_bpe.read_json(public_tokenizers.path(TOKENIZER))
    back = chunk_bpe.encode(docs.select("doc_id", "text"), spec, decoded=True).drop("text")
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
                       F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality_classifier), ("quality rules", quality_rules),
          ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination),
          ("BPE encoding and decoding", tokens)]

#: Learned scores, permutations and merges can't be said in SQL; tests hold ``run`` against
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = os.path.join(ensure_checkpoint_dir(spark), "docflow-llm", f"pipeline-{uuid.uuid4().hex}")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
    return docs
