"""Token counts as rollups that deltas maintain.

A commit is a batch of events (key, document, change): inserts, deletes and revised counts. Each event becomes signed rows -
a revision is minus the old count and plus the new one - which are summed by source, language and tokenizer version before
they leave the task. The additive totals of a batch are written to a folder of their own and then published by a marker under
the batch's id, a file that is made in one step; the state is the sum over the newest marker of each batch id. So a retry never
counts twice, and a driver that dies at any point leaves the state before or the state after, never one without the batch.

Defined results: a null or empty text counts 0 tokens and still counts as a document; null source, language or version are
groups of their own; repeated rows count as often as they occur; a batch without rows commits an empty total; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, remove

KEYS = ("source", "lang", "tokenizer")
STATE = "batch_id string, source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_inserts bigint, n_deletes bigint, n_revisions bigint"

#: Tokenizer versions: words, and words with every run of marks cut off as a token of its own.
TOKENIZERS = {
    "words-1": WORD_PATTERN,
    "words-2": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}\x20\x09-\x0D]+",
}


def n_tokens(text: Column, tokenizer: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])).cast("long"), F.lit(0).cast("long"))


def inserts(counted: DataFrame) -> DataFrame:
    """Events from rows (source, lang, tokenizer, tokens)."""
    return counted.select(*KEYS, F.lit("insert").alias("op"), F.lit(None).cast("long").alias("old"), F.col("tokens").alias("new"))


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, F.lit("delete").alias("op"), F.col("tokens").alias("old"), F.lit(None).cast("long").alias("new"))


def revisions(counted: DataFrame) -> DataFrame:
    """Events from rows (source, lang, tokenizer, was, tokens): a document counted anew under its key."""
    return counted.select(*KEYS, F.lit("revise").alias("op"), F.col("was").alias("old"), F.col("tokens").alias("new"))


def deltas(events: DataFrame) -> DataFrame:
    """The additive totals of a batch: one row per key, summed map-side before the shuffle, so a hot key costs one row a task."""
    op = F.col("op")
    one = lambda name: F.sum((op == name).cast("long"))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).otherwise(0).cast("long")
    signed = F.coalesce("new", F.lit(0)) - F.coalesce("old", F.lit(0))
    return events.groupBy(*KEYS).agg(F.sum(docs).alias("n_docs"), F.sum(signed.cast("long")).alias("n_tokens"), one("insert").alias("n_inserts"), one("delete").alias("n_deletes"), one("revise").alias("n_revisions"))


class Rollup:
    """The state in a folder that all executors see: totals/, a folder for each commit, and commits/, the markers by batch id."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commit(self, batch_id: str, events: DataFrame) -> None:
        """Writes the batch's totals; an id seen before replaces its own earlier totals and nothing else."""
        key, name = hashlib.sha256(batch_id.encode("utf-8", "surrogatepass")).hexdigest(), f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        deltas(events).withColumn("batch_id", F.lit(batch_id)).select(*(c.split()[0] for c in STATE.split(", "))).write.parquet(f"{self.folder}/totals/{name}")
        self._publish(key, name)
        for old in self._markers().get(key, [])[:-1]:  # the state no longer reads them
            remove(self.spark, f"{self.folder}/commits/{key}/{old}")
            remove(self.spark, f"{self.folder}/totals/{old}")

    def _publish(self, key: str, name: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits/{key}/{name}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at, False).close()

    def _markers(self) -> dict[str, list[str]]:
        """The markers of each batch, in order: a few for each commit, so the driver can list them."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits/*/*")
        out: dict[str, list[str]] = {}
        for x in at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or ():
            out.setdefault(x.getPath().getParent().getName(), []).append(x.getPath().getName())
        return {k: sorted(v) for k, v in out.items()}

    def batches(self) -> DataFrame:
        """The published totals of all batches."""
        paths = [f"{self.folder}/totals/{names[-1]}" for names in self._markers().values()]
        return self.spark.read.schema(STATE).parquet(*paths) if paths else self.spark.createDataFrame([], STATE)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer and the sums over all batches, without keys that nothing is left of."""
        sums = [F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_inserts", "n_deletes", "n_revisions")]
        return self.batches().groupBy(*KEYS).agg(*sums).where("n_docs <> 0 or n_tokens <> 0")


def counted(docs: DataFrame, tokenizer: str, name: str = "tokens") -> DataFrame:
    return docs.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), n_tokens(F.col("text"), tokenizer).alias(name))
