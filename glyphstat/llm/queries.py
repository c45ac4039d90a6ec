"""The operators of this subpackage bound to the given tables."""

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstat.llm import (
    bpe, conversation_repair, katz, line_dedup, mixing, phrase_dedup, quality_forest, spelling, suffix_dedup, superminhash,
    topk, toxicity, url_filters,
)

BPE_FILE = "byte_bpe_50k.json"

URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_vocabulary() -> str:
    return Path(public_tokenizers.path(BPE_FILE)).read_text()


def op1_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.without_repeats(table(spark, sf_dir, "documents"), digests=True)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), digests=True)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = quality_forest.stats(table(spark, sf_dir, "documents"))
    forest = quality_forest.fit_labelled(statistics, table(spark, sf_dir, "labels"))
    return quality_forest.judge(statistics, forest)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_common_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("kept_text", F.lit("")).cast("binary")
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(text, 256).alias("kept_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), bpe_vocabulary())


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_filters.judge(pages.select("page_id", "url"), url_filters.links(pages.select("url", "html")), URL_RULES)
    return judged.select("page.page_id", "host", "path", "rule", "verdict")


def op11_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_phrase_dedup": op1_phrase_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_mixing": op3_mixing,
    "op4_superminhash": op4_superminhash,
    "op5_topk": op5_topk,
    "op6_toxicity": op6_toxicity,
    "op7_quality_forest": op7_quality_forest,
    "op8_line_dedup": op8_line_dedup,
    "op9_bpe": op9_bpe,
    "op10_url_filters": op10_url_filters,
    "op11_katz": op11_katz,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling": op13_spelling,
}
