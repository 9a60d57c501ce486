"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. A document that a rule of the policy rejects
goes; of each group of near duplicates the one with the smallest id stays; documents with a benchmark passage go; the mix repeats
or cuts documents so that sources meet their targets, and lays them out by the shards of its tree; the last stage lays the rows
out along the Hilbert curve and adds their shard and slot.

Defined results, of every stage: an empty table gives an empty table with the same columns; extra columns are carried, whatever
their names. A null or empty text has no words, so the quality rules reject it; given to a later stage alone, it is nobody's near
duplicate and holds no passage, so it stays, and the mix takes nothing of it. A null source is a source of its own. Rows with a
null id stay, unless a near duplicate with an id is there. Of repeated rows the near-duplicate stage keeps one; every other stage
treats each of them alike.

SQL cannot express the edit distance around passages, the keyed permutations of the mix or the curve order over checksums, so
there is no ORACLE_SQL; tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.llm import decontam, hilbert, mixing, ngram_join, rules
from platter.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the policy keeps, unchanged."""
    return rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that link at 0.8 or more the row with the smallest id; all rows without words."""
    return ngram_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in which no item of the benchmark is found; an empty benchmark takes nothing away."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each run of words that the mix takes of a document in one copy, so a document may come twice, once or in part."""
    return mixing.mixed_texts(docs)


def hilbert_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot; where the rows have columns of these names, the new ones get an underscore behind."""
    own = [name + "_" * sum(c.rstrip("_") == name for c in docs.columns) for name in ("shard", "slot")]
    return hilbert.shard(docs, carry=True).select("row.*", *(F.col(c.rstrip("_")).alias(c) for c in own))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("hilbert_shards", hilbert_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
