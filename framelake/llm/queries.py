"""The registered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import read_table, shared_dir
from framelake.llm.conversation_repair import all_conversations, damage, repair_digests
from framelake.llm.cotraining import fit, score
from framelake.llm.decontaminate import contamination_report
from framelake.llm.html_extract import main_text
from framelake.llm.line_dedup import drop_boilerplate
from framelake.llm.mixing import systematic_sample
from framelake.llm.pii import KINDS, find_personal_data, listed
from framelake.llm.quality_rules import quality_report
from framelake.llm.resampling import resample
from framelake.llm.simhash import near_duplicates
from framelake.llm.substring_dedup import dedup_report
from framelake.llm.token_records import read_records, write_records
from framelake.llm.warc_zip import read_packages, write_packages

TOKENIZER = "word_bpe_49k.json"


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = main_text(read_table(spark, sf_dir, "pages"), into="text")
    return pages.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = dedup_report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return report.select("doc_id", "_dedup.n_words", "_dedup.n_removed", F.sha2("_dedup.kept_text", 256).alias("kept_sha256"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write_records(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return read_records(spark, folder, ids=False)


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, fit(docs, read_table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write_packages(read_table(spark, sf_dir, "pages"), folder)
    return read_packages(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_boilerplate(read_table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "n_lines", "n_dropped", F.sha2(F.array_join("lines", "\n"), 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    hits = contamination_report(docs.select("doc_id", "text"), benchmark)
    return hits.select("doc_id", *[f"_hits.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = systematic_sample(read_table(spark, sf_dir, "documents"))
    return sample.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_report(read_table(spark, sf_dir, "documents"))
    return report.select("doc_id", *[f"_quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return all_conversations(conversations, repair_digests(damage(conversations)))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("_pii", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, n))).cast("bigint").alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_pii")).alias("spans"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return drawn.select("doc_id", *[f"_draw.{c}" for c in ("n_features", "weight", "score", "rank")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_html_extract, op2_substring_dedup, op3_token_records, op4_cotraining, op5_warc_zip, op6_line_dedup, op7_decontaminate, op8_mixing, op9_simhash, op10_quality_rules, op11_conversation_repair, op12_pii, op13_resampling)
    return {f.__name__: f for f in found}
