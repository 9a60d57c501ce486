"""Queries over paths and requests: lookups, orders, deletions, names, extraction, packed cells."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platter.codecs import mfm
from platter.operators import extract, images, updates
from platter.operators.storage import settled, shared_folder
from platter.sources import containers
from platter.volume import virtual

from .images import _FILES, _docs, _files
from .names import _bytes_sql
from .registry import query, read
from .trees import _DOCS, _PAGES, _tree


@query(f"""
WITH t AS (SELECT path, is_dir, size FROM {_tree(_PAGES)} x), w AS (SELECT DISTINCT unnest([path, upper(path), path || '/missing']) AS wanted FROM t),
k AS (SELECT wanted, path AS found, is_dir, size, row_number() OVER (PARTITION BY wanted ORDER BY (path <> wanted)::INT, path) AS n FROM w JOIN t ON lower(path) = lower(wanted))
SELECT w.wanted, found, CASE WHEN is_dir THEN 'directory' WHEN NOT is_dir THEN 'file' ELSE 'missing' END AS kind, coalesce(size, -1)::BIGINT AS size FROM w LEFT JOIN k ON w.wanted = k.wanted WHERE n IS NULL OR n = 1""")
def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as they are, in capitals, and behind what is no directory of theirs."""
    t = virtual.tree(virtual.pages(read(spark, sf_dir, "pages")))
    wanted = F.explode(F.array(F.col("path"), F.upper("path"), F.concat(F.col("path"), F.lit("/missing"))))
    kind = F.when(F.col("is_dir"), "directory").when(~F.col("is_dir"), "file").otherwise("missing")
    return updates.lookup(t, t.select(wanted.alias("wanted"))).select("wanted", "found", kind.alias("kind"), F.coalesce("size", F.lit(-1)).cast("long").alias("size"))


@query(f"""
SELECT path, row_number() OVER (PARTITION BY parent ORDER BY is_dir DESC, lower(name), name) AS place,
  row_number() OVER (PARTITION BY parent ORDER BY upper(name), name) AS name_place FROM {_tree(_DOCS)} t""")
def ordered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each entry in its directory, directories first and by name alone."""
    t = virtual.tree(virtual.documents(read(spark, sf_dir, "documents"))).select("path", "parent", "name", "is_dir")
    first = updates.placed(t, "place", F.desc("is_dir"), F.lower("name"), "name")
    return updates.placed(first, "name_place", F.upper("name"), "name").select("path", "place", "name_place")


@query(f"""
WITH t AS (SELECT path, parent, is_dir FROM {_tree(_DOCS)} x), c AS (SELECT parent, count(*) AS n FROM t GROUP BY parent),
w AS (SELECT path AS wanted FROM t UNION ALL SELECT path || '/none' FROM t)
SELECT wanted AS path, CASE WHEN t.path IS NULL THEN 'ignored' ELSE 'deleted' END AS ffs,
  CASE WHEN t.path IS NULL THEN 'not found' WHEN n > 0 THEN 'not empty' ELSE 'deleted' END AS pfs,
  CASE WHEN t.path IS NULL THEN 'ignored' WHEN n > 0 THEN 'not empty' ELSE 'deleted' END AS fat, coalesce(n, 0)::BIGINT AS orphans
FROM w LEFT JOIN t ON t.path = wanted LEFT JOIN c ON c.parent = wanted""")
def delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What volumes answer when any one entry, or one that is not there, is to be deleted."""
    t = virtual.tree(virtual.documents(read(spark, sf_dir, "documents")))
    return updates.deletions(t, t.select(F.explode(F.array(F.col("path"), F.concat(F.col("path"), F.lit("/none")))).alias("path")))


def _name_sql(limit: int, marks: str) -> str:
    return f"CASE WHEN name = '' THEN 'empty' WHEN regexp_matches(name, '[{marks}]') THEN 'separator' WHEN length(name) > {limit} THEN 'too long' ELSE 'ok' END"


@query(f"""
SELECT doc_id, {', '.join(_name_sql(n, '/:' + chr(92) * 2 if v == 'fat' else '/:') + ' AS ' + v for v, n in updates.NAME_LIMITS.items())},
  CASE WHEN doc_id % 3 = 0 THEN 'unsupported' WHEN length(name) > {updates.COMMENT_LIMIT} THEN 'too long' ELSE 'ok' END AS comment
FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE left(coalesce(text, ''), (doc_id % 300)::INT) || CASE WHEN doc_id % 5 = 0 THEN ':' WHEN doc_id % 7 = 0 THEN chr(92) ELSE '' END END AS name FROM documents)""")
def name_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether volumes take a name or a comment."""
    i = F.col("doc_id")
    mark = F.when(i % 5 == 0, ":").when(i % 7 == 0, "\\").otherwise("")
    name = F.when(i % 9 == 0, "").otherwise(F.concat(F.substring(F.coalesce("text", F.lit("")), F.lit(1), (i % 300).cast("int")), mark))
    rows = read(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return rows.select("doc_id", *(updates.name_check(F.col("name"), v).alias(v) for v in updates.NAME_LIMITS), updates.comment_check(F.col("name"), i % 3 == 0).alias("comment"))


@query(f"SELECT volume || '/' || path AS path, octet_length(encode(text))::BIGINT AS size, md5(text) AS digest FROM {_FILES} f")
def extract_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives extracted to a tree of files, which is read again."""
    folder = f"{shared_folder(spark)}/platter/tree-{uuid.uuid4().hex}"
    made = containers.contents(images.archives(_files(spark, sf_dir)))
    path = F.concat(F.regexp_replace("image", r"\.lha$", ""), F.lit("/"), F.col("path"))
    written = settled(extract.to_folder(made.select(path.alias("path"), "content"), folder), "extracted")
    return extract.from_folder(written, folder).select("path", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("digest"))


@query(f"""
SELECT doc_id, (octet_length(encode(t)) * 2 + 1)::BIGINT AS size, coalesce(list_sum(list_transform({_bytes_sql('encode(t)')}, lambda b: bit_count(b))), 0)::BIGINT AS ones, true AS same
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def packed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells as codes of two bits, with an end code, and back."""

    def of(raw: bytes) -> tuple[int, int, bool]:
        packed = mfm.pack_cells(raw)
        return len(packed), int(np.bitwise_count(np.frombuffer(packed, np.uint8) & 0xAA).sum()), mfm.unpack_cells(packed) == raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # a content at a time: its codes take many times its size
            size, ones, same = zip(*(of(x.as_py()) for x in b["raw"]), strict=True) if len(b) else ((), (), ())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(size, pa.int64()), pa.array(ones, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "size", "ones", "same"])

    rows = _docs(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "raw")
    return rows.mapInArrow(run, "doc_id bigint, size bigint, ones bigint, same boolean")
