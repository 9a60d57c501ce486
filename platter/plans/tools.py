"""Queries over the tools' functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platter.functions import names, tooling

from .registry import query, read


@query("""
WITH k AS (SELECT p_partkey, (CASE WHEN p_partkey % 3 = 0 THEN 5264467 ELSE 4476755 END * 256 + p_partkey % 9)::BIGINT AS v FROM part)
SELECT p_partkey, v AS dos_type, CASE WHEN v // 256 = 5264467 THEN 'PTS' ELSE 'DOS' END || chr(92) || (v % 256) AS shown,
  CASE WHEN v // 256 = 4476755 AND v % 256 IN (0, 2, 4) THEN 'OFS' WHEN v // 256 = 4476755 AND v % 256 IN (6, 7) THEN 'FFS long names' WHEN v // 256 = 4476755 THEN 'FFS' ELSE 'unknown' END AS family FROM k""")
def dos_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F07, F08, P09."""
    v = (F.when(F.col("p_partkey") % 3 == 0, 0x505453).otherwise(0x444F53).cast("long") * 256 + F.col("p_partkey") % 9).cast("long")
    return read(spark, sf_dir, "part").select("p_partkey", v.alias("dos_type"), names.dos_type(v).alias("shown"), tooling.file_system_name(v).alias("family"))


@query("""
SELECT s_suppkey, 'DH' || s_suppkey AS name, (CASE WHEN s_suppkey % 4 = 0 THEN 1346654979 ELSE 1146049283 END)::BIGINT AS dos_type, (s_suppkey * 7)::BIGINT AS cylinders, s_suppkey % 2 = 0 AS bootable, (s_suppkey % 5 - 2)::BIGINT AS priority
FROM supplier WHERE s_suppkey % 11 <> 0""")
def partition_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """specifications read from text; those whose blocks are no power of two go."""
    k = F.col("s_suppkey")
    text = F.concat_ws(":", F.concat(F.lit("DH"), k), F.when(k % 4 == 0, "pds3").otherwise("0x444f5303"), (k * 7).cast("string"), F.when(k % 2 == 0, "1").otherwise("0"), (k % 5 - 2).cast("string"), F.when(k % 11 == 0, "3").otherwise("2"))
    spec = read(spark, sf_dir, "supplier").select("s_suppkey", tooling.partition_spec(text).alias("s")).where("s is not null")
    return spec.select("s_suppkey", "s.name", "s.dos_type", "s.cylinders", "s.bootable", "s.priority")


@query(r"""
SELECT doc_id, coalesce(CASE WHEN regexp_extract(t, '\$VER:((?s:.){0,128})', 1) <> '' AND regexp_extract(regexp_extract(t, '\$VER:((?s:.){0,128})', 1), '([0-9]+)\.([0-9]+)', 1) <> ''
  THEN regexp_extract(regexp_extract(t, '\$VER:((?s:.){0,128})', 1), '([0-9]+)\.([0-9]+)', 1)::BIGINT * 65536 + regexp_extract(regexp_extract(t, '\$VER:((?s:.){0,128})', 1), '([0-9]+)\.([0-9]+)', 2)::BIGINT END, -1)::BIGINT AS version
FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN '$VER: Tool ' || (doc_id % 50) || '.' || (doc_id % 7) || ' (1.1.99)' ELSE '' END AS t FROM documents)""")
def version_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19."""
    i = F.col("doc_id")
    mark = F.when(i % 2 == 0, F.concat(F.lit("$VER: Tool "), (i % 50).cast("string"), F.lit("."), (i % 7).cast("string"), F.lit(" (1.1.99)"))).otherwise("")
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce(tooling.version_of(F.concat("text", mark)), F.lit(-1)).cast("long").alias("version"))


@query("""
SELECT o_orderkey, CASE WHEN s >= 1073741824 THEN printf('%.1f GiB (%.1f GB)', s / 1073741824.0, s / 1000000000.0) ELSE printf('%.0f MiB', s / 1048576.0) END AS label
FROM (SELECT o_orderkey, o_orderkey * 1234567 AS s FROM orders)""")
def size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F22."""
    return read(spark, sf_dir, "orders").select("o_orderkey", tooling.size_label(F.col("o_orderkey") * 1234567).alias("label"))


@query(r"""
WITH r AS (SELECT doc_id, concat_ws('/', source, lang) AS dir, regexp_extract(text, '^\s*(\S{1,40})', 1) AS name FROM documents),
c AS (SELECT *, regexp_replace(strip_accents(name), '[^\x00-\x7F]', '', 'g') AS clean FROM r)
SELECT doc_id, dir, name, clean, count(*) OVER (PARTITION BY dir, clean) > 1 AS meets FROM c WHERE clean <> '' AND clean <> name""")
def ascii_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that change when only ASCII is kept, longest first, and which of them meet in a directory."""
    name = F.regexp_extract("text", r"^\s*(\S{1,40})", 1)
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("dir"), name.alias("name"))
    rows = rows.withColumn("clean", tooling.ascii_name(F.col("name"))).where("clean is not null")
    n = rows.groupBy("dir", "clean").agg(F.count("*").alias("n"))
    return rows.join(n, ["dir", "clean"]).select("doc_id", "dir", "name", "clean", (F.col("n") > 1).alias("meets")).orderBy(F.char_length("name").desc(), "doc_id")


@query("""
SELECT event_id, 'hs--rwed' AS mask, epoch_us(date_trunc('second', ts)) AS us, event_type AS comment FROM events""")
def sidecar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecar lines written and read."""
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    line = tooling.sidecar_line(F.lit("hs--rwed"), ts, F.col("event_type"))
    out = read(spark, sf_dir, "events").select("event_id", tooling.parse_sidecar(line).alias("s"))
    return out.select("event_id", "s.mask", F.unix_micros("s.modified").alias("us"), "s.comment")


@query("""
SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS place, length(text)::BIGINT AS n FROM documents QUALIFY place <= 10""")
def largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest files of each volume."""
    w = W.partitionBy("source").orderBy(F.char_length("text").desc(), "doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", F.row_number().over(w).cast("long").alias("place"), F.char_length("text").cast("long").alias("n")).where("place <= 10")
