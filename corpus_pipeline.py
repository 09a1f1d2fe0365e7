"""The corpus pipeline: what becomes of ``documents`` before a model is trained on them.

Toxic documents go, one document of each near-duplicate group stays, documents that hold benchmark
items go, sources are mixed to their target weights (documents repeat, or are left out, as the mix
says), and the mix is dealt into shards of equal bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinroster.llm import jaccard, leaks, mixing, sharding, support, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = support.table(spark, sf_dir, "labels")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.decontaminate(docs, support.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixture),
    ("shards", shards),
]

#: The classifier, the sampled paths and the splitters have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a stage's table is deleted once the next is written.

    Null and empty texts are clean and without copies or benchmark items, but have no words, so the
    mixture never takes them; null ids are documents like others; very long texts are read whole by
    every stage; of repeated rows one stays before the mixture, which may repeat it; an empty table of
    documents gives an empty table; without labels nothing is toxic, without benchmark nothing leaks.
    Columns beside those of ``documents`` go through as they are, whatever their names; only ``shard``
    and ``slot`` are replaced.
    """
    docs = support.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, support.written(stage(spark, docs, sf_dir), f"stage-{name}")
        if i:
            support.drop_written(before)
    return docs
