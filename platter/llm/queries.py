"""The queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, hilbert, linkgraph, mixing, ngram_join, pfp, repair, rollup, rules, wrapper
from .common import new_folder, table


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read(spark, sf_dir, "documents"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard(read(spark, sf_dir, "documents"))


def op3_repair_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """tokenizer: the vocabulary file; without one, the machine's own copy of public_tokenizers names it."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return repair.digest(read(spark, sf_dir, "documents"), str(tokenizer))


def op4_pigeonhole_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(read(spark, sf_dir, "pages"))


def op6_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.verdicts(read(spark, sf_dir, "pages"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over the whole corpus: both tokenizer versions counted in, the first one committed twice; toxic documents
    deleted from both; documents of low quality revised to what `words-2` counts without marks."""
    docs = read(spark, sf_dir, "documents")
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long"), F.lit(0).cast("long"))
    once = table(docs.select("doc_id", "source", "lang", rollup.n_tokens(F.col("text"), "words-1").alias("w1"), rollup.n_tokens(F.col("text"), "words-2").alias("w2"), words.alias("clean")), "counts")
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    seen = once.join(labels, "doc_id")
    of = lambda df, version, tokens, **more: df.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(tokens).alias("tokens"), *(F.col(c).alias(k) for k, c in more.items()))
    state = rollup.Rollup(spark, new_folder(spark, "rollup"))
    first = rollup.inserts(of(once, "words-1", "w1"))
    state.commit("insert words-1", first)
    state.commit("insert words-2", rollup.inserts(of(once, "words-2", "w2")))
    state.commit("insert words-1", first)
    toxic = seen.where("toxic = 1")
    state.commit("delete toxic", rollup.deletes(of(toxic, "words-1", "w1").unionByName(of(toxic, "words-2", "w2"))))
    state.commit("revise low quality", rollup.revisions(of(seen.where("quality = 0 and toxic = 0"), "words-2", "clean", was="w2")))
    return state.totals()


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.digest(read(spark, sf_dir, "documents"))


def op9_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp.digest(read(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_sources, op2_hilbert_shards, op3_repair_tokens, op4_pigeonhole_decontam, op5_wrapper_text, op6_link_graph, op7_token_rollup, op8_rule_ledger, op9_prefix_free_parsing, op10_ngram_jaccard)}
