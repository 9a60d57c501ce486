"""Queries over trees of files: listings, roll-ups, unions, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platter.functions import names
from platter.operators import trees
from platter.volume import virtual

from .registry import query, read

_DOCS = "(SELECT 'documents' AS volume, concat_ws('/', source, lang, 'doc' || doc_id || '.txt') AS path, octet_length(encode(text))::BIGINT AS size FROM documents)"
_PAGES = r"(SELECT 'pages' AS volume, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path, octet_length(encode(html))::BIGINT AS size FROM pages)"
_CONV = "(SELECT 'conversations' AS volume, 'conv' || conv_id || '/' || lpad(turn::VARCHAR, 4, '0') || '_' || role AS path, octet_length(encode(text))::BIGINT AS size FROM conversations)"
_PARTS = "list_filter(string_split(path, '/'), lambda x: x <> '')"


def _tree(files: str) -> str:
    return f"""(SELECT volume, path, parent, name, bool_or(d) AS is_dir, (CASE WHEN bool_or(d) THEN 0 ELSE coalesce(max(size) FILTER (NOT d), 0) END)::BIGINT AS size, depth
  FROM (SELECT volume, size, array_to_string(p[:i], '/') AS path, array_to_string(p[:i - 1], '/') AS parent, p[i] AS name, i < len(p) AS d, i::BIGINT AS depth
        FROM (SELECT volume, size, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT volume, size, {_PARTS} AS p FROM {files} f)))
  GROUP BY volume, path, parent, name, depth)"""


@query(f"""
SELECT dir, depth, count(*)::BIGINT AS items, sum(size)::BIGINT AS bytes, max(size)::BIGINT AS largest, printf('%d MB', cast(round(sum(size) / 1048576.0) AS BIGINT)) AS label
FROM (SELECT size, array_to_string(p[:i], '/') AS dir, i::BIGINT AS depth FROM (SELECT size, p, unnest(range(0, len(p))) AS i FROM (SELECT size, {_PARTS} AS p FROM {_DOCS} f)))
GROUP BY dir, depth""")
def volume_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and bytes of every directory, all levels."""
    out = trees.rolled_up(virtual.documents(read(spark, sf_dir, "documents"))).drop("volume")
    return out.withColumn("label", F.concat(F.round(F.col("bytes") / 1048576.0).cast("long").cast("string"), F.lit(" MB")))


@query(f"SELECT path, parent, name, is_dir, size, depth FROM {_tree(_PAGES)} t")
def dir_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories that flat paths imply."""
    return virtual.tree(virtual.pages(read(spark, sf_dir, "pages"))).drop("volume")


@query(f"""
WITH RECURSIVE t AS (SELECT * FROM {_tree(_PAGES)} x),
r(path, is_dir, hop) AS (SELECT path, is_dir, 0::BIGINT FROM t WHERE parent = '' UNION ALL SELECT t.path, t.is_dir, hop + 1 FROM r JOIN t ON t.parent = r.path WHERE r.is_dir AND hop < 12)
SELECT path, is_dir, hop FROM r""")
def recursive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries reached from the root, at most 12 levels down."""
    virtual.tree(virtual.pages(read(spark, sf_dir, "pages"))).select("path", "parent", "is_dir").createOrReplaceTempView("platter_tree")
    spark.conf.set("spark.sql.cteRecursionRowLimit", -1)
    return spark.sql("""
        WITH RECURSIVE r(path, is_dir, hop) AS (
          SELECT path, is_dir, 0L FROM platter_tree WHERE parent = ''
          UNION ALL SELECT t.path, t.is_dir, hop + 1 FROM r JOIN platter_tree t ON t.parent = r.path WHERE r.is_dir AND hop < 12)
        SELECT path, is_dir, hop FROM r""")


BUDGET = 4000


@query(f"""
WITH t AS (SELECT * FROM {_tree(_DOCS)} a UNION ALL SELECT * FROM {_tree(_PAGES)} b),
k AS (SELECT volume, path, is_dir, depth, row_number() OVER (ORDER BY volume, path) - 1 AS rank, count(*) OVER () AS total FROM t WHERE depth <= 12)
SELECT volume, path, is_dir, depth, rank::BIGINT AS rank, total >= {BUDGET} AS truncated FROM k WHERE rank < {BUDGET}""")
def bounded_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entries of all volumes together, parents before children; a budget used up says so."""
    both = virtual.documents(read(spark, sf_dir, "documents")).unionByName(virtual.pages(read(spark, sf_dir, "pages")))
    rows = virtual.tree(both).where("depth <= 12").select("volume", "path", "is_dir", "depth")
    first = rows.orderBy("volume", "path").limit(BUDGET)  # the window sees no more than these
    w = W.orderBy("volume", "path")
    return first.withColumns({"rank": (F.row_number().over(w) - 1).cast("long"), "truncated": F.count("*").over(W.partitionBy()) >= BUDGET})


@query(f"""
SELECT volume, path, size, CASE WHEN size = 0 THEN 'empty' WHEN size > 20000 THEN 'large' END AS note FROM {_DOCS} a
UNION ALL SELECT volume, path, size, NULL FROM {_PAGES} b UNION ALL SELECT volume, path, size, NULL FROM {_CONV} c""")
def union_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of unlike containers in one listing."""
    note = F.when(F.col("size") == 0, "empty").when(F.col("size") > 20000, "large")
    docs = virtual.documents(read(spark, sf_dir, "documents")).withColumn("note", note)
    rest = virtual.pages(read(spark, sf_dir, "pages")).unionByName(virtual.conversations(read(spark, sf_dir, "conversations")))
    return docs.unionByName(rest, allowMissingColumns=True)


@query(f"""
WITH n AS (SELECT doc_id % 50 AS dir, doc_id AS arrival, CASE WHEN doc_id % 3 = 0 THEN upper(lang) WHEN doc_id % 3 = 1 THEN lang ELSE upper(left(lang, 1)) || substr(lang, 2) END || '_' || source AS name FROM documents)
SELECT arrival, dir, name, first_value(name) OVER (PARTITION BY dir, translate(name, '{names.ASCII_UPPER}', '{names.ASCII_LOWER}') ORDER BY arrival) AS merged FROM n""")
def case_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of spellings that differ in case, a directory keeps the first."""
    i, lang = F.col("doc_id"), F.col("lang")
    name = F.concat(F.when(i % 3 == 0, F.upper(lang)).when(i % 3 == 1, lang).otherwise(F.concat(F.upper(F.left(lang, F.lit(1))), F.substring(lang, 2, 99))), F.lit("_"), F.col("source"))
    rows = read(spark, sf_dir, "documents").select(i.alias("arrival"), (i % 50).alias("dir"), name.alias("name"))
    folded = F.translate("name", names.ASCII_UPPER, names.ASCII_LOWER)
    # the first spelling by group, summed map-side, and joined: no window over a group of any size
    first = rows.groupBy("dir", folded.alias("folded")).agg(F.min_by("name", "arrival").alias("merged"))
    return rows.withColumn("folded", folded).join(first, ["dir", "folded"]).select("arrival", "dir", "name", "merged")


@query(f"""
SELECT d.doc_id, coalesce(l.quality * 16 + l.toxic * 64, CASE WHEN starts_with(text, 'The') THEN 64 ELSE 0 END)::BIGINT AS bits,
  {' || '.join(f"CASE WHEN (coalesce(l.quality * 16 + l.toxic * 64, CASE WHEN starts_with(text, 'The') THEN 64 ELSE 0 END) & {1 << (7 - i)}) {'<>' if i < 4 else '='} 0 THEN '{c}' ELSE '-' END" for i, c in enumerate(names.MASK))} AS mask,
  l.doc_id IS NOT NULL AS has_sidecar FROM documents d LEFT JOIN labels l USING (doc_id)""".replace("l.doc_id IS NOT NULL", "l.quality IS NOT NULL"))
def sidecar_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes come from a file's sidecar; without one, from a rule."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    own = labels.select("doc_id", (F.col("quality") * 16 + F.col("toxic") * 64).cast("long").alias("own"))
    rows = docs.select("doc_id", F.when(F.col("text").startswith("The"), 64).otherwise(0).cast("long").alias("rule")).join(own, "doc_id", "left")
    bits = F.coalesce("own", "rule")
    return rows.select("doc_id", bits.alias("bits"), names.protection_mask(bits).alias("mask"), F.col("own").isNotNull().alias("has_sidecar"))


@query(f"""
SELECT path, repeat('    ', (depth - 1)::INT) || name || CASE WHEN is_dir THEN '/' ELSE '  ' || size END AS line FROM {_tree(_DOCS)} t""")
def plain_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an indented listing, with the path to put them in order by."""
    t = virtual.tree(virtual.documents(read(spark, sf_dir, "documents")))
    end = F.when(F.col("is_dir"), F.lit("/")).otherwise(F.concat(F.lit("  "), F.col("size").cast("string")))
    return t.select("path", F.concat(F.repeat(F.lit("    "), (F.col("depth") - 1).cast("int")), F.col("name"), end).alias("line"))


@query("""
WITH w AS (SELECT doc_id, source AS dir, upper(lang) || doc_id AS name FROM documents)
SELECT w.doc_id, w.dir, 'x' || w.name AS renamed, EXISTS (SELECT 1 FROM w e WHERE e.dir = w.dir AND lower(e.name) = lower('x' || w.name) AND e.doc_id <> w.doc_id) AS collides FROM w
UNION ALL SELECT w.doc_id, w.dir, lower(w.name), EXISTS (SELECT 1 FROM w e WHERE e.dir = w.dir AND lower(e.name) = lower(w.name) AND e.doc_id <> w.doc_id) FROM w
UNION ALL SELECT w.doc_id, w.dir, left(w.name, 4), EXISTS (SELECT 1 FROM w e WHERE e.dir = w.dir AND lower(e.name) = lower(left(w.name, 4)) AND e.doc_id <> w.doc_id) FROM w""")
def rename_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames that would meet another entry; an entry may change its own case."""
    e = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("dir"), F.concat(F.upper("lang"), F.col("doc_id").cast("string")).alias("name"))
    wanted = F.array(F.concat(F.lit("x"), F.col("name")), F.lower("name"), F.substring("name", 1, 4))
    asked = e.select("doc_id", "dir", F.explode(wanted).alias("renamed"))
    # the least and the largest id of a name are enough to tell whether another one has it
    held = e.groupBy("dir", F.lower("name").alias("folded")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    met = asked.withColumn("folded", F.lower("renamed")).join(held, ["dir", "folded"], "left")
    other = F.coalesce((F.col("low") != F.col("doc_id")) | (F.col("high") != F.col("doc_id")), F.lit(False))
    return met.select("doc_id", "dir", "renamed", other.alias("collides"))


@query(f"""
WITH t AS (SELECT * FROM {_tree(_DOCS)} x), gone AS (SELECT DISTINCT source || '/' || lang AS dir FROM documents WHERE lang = 'de' UNION SELECT DISTINCT source FROM documents WHERE source LIKE '%3')
SELECT path, is_dir, size FROM t WHERE NOT EXISTS (SELECT 1 FROM gone WHERE t.path = gone.dir OR starts_with(t.path, gone.dir || '/'))""")
def delete_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when directories go with all that is in them."""
    docs = read(spark, sf_dir, "documents")
    t = virtual.tree(virtual.documents(docs))
    gone = docs.where("lang = 'de'").select(F.concat_ws("/", "source", "lang").alias("gone")).union(docs.where("source like '%3'").select("source"))
    return trees.without(t, gone.distinct()).select("path", "is_dir", "size")
