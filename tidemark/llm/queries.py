"""The corpus queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, licenses, maxscore, media, mixing, packing, resample, simhash, substring, toxicity


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(common.read_spread(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(common.read_spread(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.read_spread(spark, sf_dir, "documents"))


def op4_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.sample(common.read_spread(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return found.select("doc_id", *(F.round(c, 6).alias(c) for c in ("log_weight", "noisy")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read_spread(spark, sf_dir, "documents"), tokenizer_path())


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(common.read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.read_spread(spark, sf_dir, "documents"))


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    rows = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(rows.unionByName(extra))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.read(spark, sf_dir, "documents")).drop("copies")


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_substring_dedup,
        op3_license_scan,
        op4_quality_resample,
        op5_packing,
        op6_media_columns,
        op7_simhash,
        op8_maxscore,
        op9_chat_format,
        op10_mixing,
    )
}

#: For the others SQL has no form; tests hold them against brute force, round trips or held-out labels.
ORACLE_SQL = {
    "op2_substring_dedup": substring.ORACLE,
    "op3_license_scan": licenses.oracle(),
    "op4_quality_resample": resample.ORACLE,
    "op8_maxscore": maxscore.ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
