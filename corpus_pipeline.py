"""From raw documents to token records: quality rules, near-dedup, decontamination, mixing, binary output.

Each stage but the last hands on documents with their own columns, whatever further ones there are; each works on all
that its predecessor kept. Defined results: null and empty texts fail the quality rules; of repeated rows and copies one
stays; rows without an id are never taken for copies; an empty table gives no records.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framelake.llm.common import discard, materialize, read_table, shared_dir
from framelake.llm.decontaminate import drop_contaminated
from framelake.llm.mixing import mix
from framelake.llm.quality_rules import keep_good
from framelake.llm.simhash import keep_one
from framelake.llm.token_records import read_records, write_records

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the quality rules."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of the benchmark."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents until the sources have their target weights."""
    return mix(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token records and returns what reading them back gives: a row a record."""
    folder = shared_dir(spark)
    write_records(docs, folder, public_tokenizers.path(TOKENIZER))
    return read_records(spark, folder, ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_records", token_records),
]

#: SQL can't express the fingerprints' closure and the token ids; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a token record: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``. What a stage has written is deleted once the next one has read it."""
    docs, written = read_table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        discard(*written)
        written = [docs]
    records = STAGES[-1][1](spark, docs, sf_dir)
    discard(*written)
    return records
