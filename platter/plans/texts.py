"""Queries over contents: line transforms and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.functions import names, texts

from .registry import query, read

_DOS = "chr(65279) || replace(replace(text, chr(10), chr(13) || chr(10)), 'a' || chr(13), 'a' || chr(13) || chr(13))"
_NORMAL = "regexp_replace(regexp_replace({}, '^' || chr(65279), ''), chr(13) || chr(10) || '?', chr(10), 'g')"
_LOW = f"translate({{}}, '{names.ASCII_UPPER}', '{names.ASCII_LOWER}')"


@query(f"SELECT doc_id, md5({_NORMAL.format(_DOS)}) AS digest, length({_NORMAL.format(_DOS)})::BIGINT AS n FROM documents")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts with a byte order mark and mixed line ends."""
    mixed = F.concat(F.lit("﻿"), F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.lit("a\r"), F.lit("a\r\r")))
    out = texts.normalized(mixed)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(out).alias("digest"), F.char_length(out).cast("long").alias("n"))


@query(f"""
SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN starts_with({_LOW.format('x')}, 'the ') THEN 'THE LINE' ELSE x END), chr(10))) AS digest,
  len(list_filter(string_split(text, chr(10)), lambda x: starts_with({_LOW.format('x')}, 'the ')))::BIGINT AS n FROM documents""")
def line_prefix_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F32."""
    hits = F.size(F.filter(texts.lines(F.col("text")), lambda x: F.translate(x, names.ASCII_UPPER, names.ASCII_LOWER).startswith("the "))).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(texts.replace_line_prefix(F.col("text"), "The ", "THE LINE")).alias("digest"), hits.alias("n"))


@query("""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, text, ls, coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '(?i)^(?:and|of|de) ')), true), 0) AS k FROM l)
SELECT doc_id, k::BIGINT AS line, md5(CASE WHEN k > 0 THEN array_to_string(list_concat(list_concat(ls[:k - 1], ['; inserted']), ls[k:]), chr(10)) ELSE text END) AS digest FROM p""")
def insert_before_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line before the first one that matches."""
    first = F.array_position(F.transform(texts.lines(F.col("text")), lambda x: x.rlike("(?i)^(?:and|of|de) ")), F.lit(True))
    return read(spark, sf_dir, "documents").select("doc_id", first.alias("line"), F.md5(texts.insert_before_line(F.col("text"), "(?:and|of|de) ", "; inserted")).alias("digest"))


@query(r"""
SELECT conv_id, turn, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '(?i)([a-z])([a-z]+)', '\2-\1', 'g')), chr(10))) AS digest FROM conversations""")
def regex_replace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """groups swapped on every line."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(texts.regex_replace_lines(F.col("text"), r"([a-z])([a-z]+)", "{2}-{1}", ignore_case=True)).alias("digest"))


_BYTES = "(SELECT 'doc' AS kind, doc_id AS id, encode(text) AS b FROM documents UNION ALL SELECT 'page', page_id, encode(html) FROM pages UNION ALL SELECT 'made', e, encode('a' || repeat(chr(1 + (e % 5)::INT), (e % 9)::INT) || repeat('b', (e % 40)::INT)) FROM (SELECT event_id AS e FROM events))"


@query(f"""
SELECT kind, id, CASE WHEN substr(h, 1, 8) = '464F524D' AND substr(h, 17, 8) IN ('494C424D', '50424D20') THEN 'bitmap' WHEN substr(h, 1, 4) = 'E310' THEN 'icon'
  WHEN n = 0 OR 20 * len(list_filter(list_transform(range(least(n, 65536)), lambda i: substr(h, 2 * i + 1, 2)),
     lambda x: (x < '20' AND x NOT IN ('09', '0A', '0C', '0D')) OR x BETWEEN '7F' AND '9F')) < least(n, 65536) THEN 'text' ELSE 'hex' END AS content FROM (SELECT kind, id, hex(b) AS h, octet_length(b) AS n FROM {_BYTES} f)""")
def classify_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What previews show of documents, pages and made contents with control codes."""
    docs = read(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("b"))
    pages = read(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").cast("binary").alias("b"))
    e = F.col("event_id")
    made = F.concat(F.lit("a"), F.repeat(F.chr(1 + e % 5), (e % 9).cast("int")), F.repeat(F.lit("b"), (e % 40).cast("int")))
    events = read(spark, sf_dir, "events").select(F.lit("made").alias("kind"), e.alias("id"), made.cast("binary").alias("b"))
    return docs.unionByName(pages).unionByName(events).select("kind", "id", texts.content_kind(F.col("b")).alias("content"))
