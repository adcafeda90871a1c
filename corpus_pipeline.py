"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridframe.llm import common, decontaminate, language_id, mixing, near_copies, token_output
from gridframe.llm.queries import END_ID, MIX, tokenizer_file


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the others go.  Rows without an id stay where their text has a language:
    the verdict is found by id and text, so rows that share an id each have their own.
    """
    return language_id.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose five-word shingles have a Jaccard similarity of at least 0.8."""
    return near_copies.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, MIX)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens in the order in which the mix left the rows, so that ``start`` ascends with its slots."""
    path = common.scratch(spark, "tokens")
    token_output.write_tokens(token_output.as_stored(docs), path, tokenizer_file(), END_ID, token_output.STORED)
    return token_output.digests(spark, path)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage wrote for itself, and what it read, goes when its own table is written."""
    docs, begin = common.table(spark, sf_dir, "documents"), common.scratch_mark()
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        common.remove_scratch(spark, begin, common.scratch_mark() - 1)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages are trained models, connected components and a tokenizer: SQL can't state their rows.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
