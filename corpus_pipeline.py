"""The corpus pipeline: toxic documents go, repeated lines go, of near duplicates one document stays, sources are mixed
to target weights, and what is left is encoded. Part of subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import bpe, line_dedup, minhash, mixing, toxicity
from engram.llm.common import read, written

#: Token shares of the domains (labels.quality) that the mixture aims at; documents of high quality are not thinned.
TARGETS = {0: 0.1, 1: 0.9}
ORACLE_SQL = None


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is below 0.5; the model learns from the labelled ones of docs. Null and empty texts
    score as texts without a toxic passage and stay; rows that repeat score alike; an empty table gives an empty one."""
    model = toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three documents or more stay in the last one only; n_chars follows the text. Every row stays: null and empty
    texts become empty, and texts may become so. Rows of a null id are the smallest, rows that repeat an id count each."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id. Null and empty texts and rows of a null id are like
    nothing and stay; rows that repeat an id stay or go together."""
    return minhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by fitted rates, none above one: surplus domains are thinned to their share, the others stay whole. Null and
    blank texts stay; without labels or without any token every row stays as far as the targets allow."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("domain"))
    return mixing.resample(mixing.mix_sources(docs, labels, TARGETS, total="least", most=1.0)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with token_ids, n_tokens and the decoded text; null and empty texts have no ids and decode to the empty text."""
    return bpe.encode(docs, decoded="decoded")


STAGES = [("toxicity", toxic_out), ("line dedup", lines_once), ("minhash near-dedup", near_copies_out), ("mixing", mixed), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each over the written result of the one before."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
