"""The corpus pipeline: quality rules, near-duplicate removal, removal of
repeated passages, mixing of the sources, packing into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes every stage's result as Parquet in the shared checkpoint folder and
rereads it as the next one's ``docs``.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roomledger.llm import minhash, mixing, packing, rules, suffix
from roomledger.llm.queries import read, tokenizer_path
from roomledger.session import scratch_dir, scratch_under
from roomledger.sources.sinks import delete_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    return rules.keep_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return minhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a smaller document also has go."""
    return suffix.without_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("source_mixing", source_mixing), ("packing", sequences)]

# Learned rules, sketches, Newton steps and a linear program have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        # what a stage stages for itself goes when its result is written, and so does what it has read
        work, path = scratch_dir(spark, f"pipeline-{name}-work"), scratch_dir(spark, f"pipeline-{name}")
        with scratch_under(work):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        for folder in (work, before):
            if folder is not None:
                delete_folder(spark, folder)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
