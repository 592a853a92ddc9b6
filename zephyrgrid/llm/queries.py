"""The queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrgrid.llm import (
    bpe, chat, fingerprint, forest, jaccard, langid, packing, pii, quality, resample, runs, simple8b, topk)

# where the tokenizer files are; a parameter of the session, else the installed package of public files
TOKENIZERS = "zephyrgrid.tokenizers"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get(TOKENIZERS, None)
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers
    return public_tokenizers.path(name)


def query(name: str, oracle: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if oracle:
            ORACLE[name] = oracle
        return build
    return keep


@query("op1_exact_top_k", topk.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5)


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_file(spark, "word_bpe_49k.json"))
    digest = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(digest)


@query("op3_ngram_jaccard")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(table(spark, sf_dir, "documents"))


@query("op4_simhash_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


@query("op5_pii_disclosure")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predict(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_simple8b_tokens")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = simple8b.write(table(spark, sf_dir, "documents"), tokenizer_file(spark, "byte_bpe_50k.json"))
    return simple8b.read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op9_bpe_round_trip")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file(spark, "byte_bpe_50k.json")
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, ["doc_id"]), path)
    return both.select(
        "doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op10_chat_formatting", chat.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"))


@query("op12_importance_resampling")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_nearest_neighbours")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = forest.usable_vectors(table(spark, sf_dir, "embeddings"))
    return forest.nearest(forest.index(vectors), F.col("vec_id") % 50 == 0, k=5)
