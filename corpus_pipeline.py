"""A corpus pipeline: toxic documents go, then copies and near copies, sources are mixed, and what is left is tokenized."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.llm import bpe, exact_dedup, mixing, near_dedup, registry, toxicity
from ontomill.plans.rounds import checkpoint_dir, remove

#: Domains that the mixing stage weighs (toxic documents are gone by then) and their shares of tokens.
DOMAINS = ("good", "poor")
SHARES = (0.9, 0.1)
#: Jaccard similarity of five-word shingles from which a document is a near copy.
SIMILARITY = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the lexicon is learned from labelled rows of ``docs``."""
    model = toxicity.learn(docs, registry.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model, threshold=registry.TOXIC_THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts, the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the least doc_id.

    Fingerprints of five-word shingles differ in about nine bits at a similarity of 0.8, out of reach of a threshold of a few
    bits. Fingerprints of words therefore find the candidates, three a text, and a link holds if the whole texts' five-word
    shingles have a similarity of 0.8 or more.
    """
    return near_dedup.drop_near_copies(docs, similarity=SIMILARITY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that expected tokens of good and poor documents stand at the shares.

    Poor documents are lowered where they have more than their share and repeated where they have less; good ones are not lowered
    to make up for scarce poor ones.
    """
    labels = registry.labelled_domains(registry.table(spark, sf_dir, "labels")).where(F.col("domain").isin(*DOMAINS))
    return mixing.mixed(docs, mixing.fit_domains(docs, labels, DOMAINS), SHARES, whole=DOMAINS.index("good"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document."""
    return bpe.digests(docs, registry.tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("bpe", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents stand as Parquet in the shared checkpoint folder until the next stage is written."""
    docs = registry.table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        at = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)  # its reader is done
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the learned lexicon, the fingerprints or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL = {}
