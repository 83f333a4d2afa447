"""The training-data queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ontomill.llm import bpe, exact_dedup, media, mixing, native_queries, near_dedup, toxicity
from ontomill.llm.columns import crc32_hex_mod4

#: The tokenizer of op9 and of the pipeline, in the public package of tokenizer files.
TOKENIZER = "word_bpe_49k.json"
TOXIC_THRESHOLD = 0.3
#: Domains by label, and the shares of tokens that they are to have.
DOMAINS = ("good", "poor", "toxic")
SHARES = (0.86, 0.12, 0.02)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; the lexicon is learned from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    held = F.coalesce(crc32_hex_mod4() == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC_THRESHOLD).cast("int").alias("predicted"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal texts; the largest doc_id stays."""
    out = exact_dedup.duplicate_classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


SQL_OP2 = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of fingerprints that differ in three bits or fewer."""
    out = near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def labelled_domains(labels: DataFrame) -> DataFrame:
    """``id, domain`` by label: toxic before poor before good; rows without both labels are left out."""
    y = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return y.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "good").otherwise("poor").alias("domain"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors over the labels' domains, and the rate that brings expected token totals to the shares."""
    docs = table(spark, sf_dir, "documents")
    model = mixing.fit_domains(docs, labelled_domains(table(spark, sf_dir, "labels")), DOMAINS)
    members = mixing.durable(mixing.memberships(docs, model))
    steps, _ = mixing.fit_rates(members, SHARES)
    posteriors = [F.round(F.col("p")[i], 6).alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return members.select(F.col("id").alias("doc_id"), "n_tokens", *posteriors, F.round(mixing.rate_of(steps, F.col("p")), 6).alias("rate"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text that they decode to, as digests."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as mu-law samples of a WAVE file, read back, with features."""
    return media.media_digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_simhash": op3_simhash,
    "op4_line_dedup": native_queries.op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_pii": native_queries.op6_pii,
    "op7_url_filter": native_queries.op7_url_filter,
    "op8_chat": native_queries.op8_chat,
    "op9_bpe": op9_bpe,
    "op10_media": op10_media,
}

SQL = {"op2_exact_dedup": SQL_OP2} | native_queries.SQL
