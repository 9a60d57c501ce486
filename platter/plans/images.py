"""Queries through images, archives and codecs, there and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platter.codecs import icons, lzh, mfm, pictures, prefs, zips
from platter.operators import images
from platter.operators.dealing import dealt
from platter.sources import containers

from .registry import query, read


def _result(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


_L, _B, _S = T.LongType(), T.BooleanType(), T.StringType()


def _each(df: DataFrame, schema: T.StructType, of) -> DataFrame:
    """of(row) -> a tuple for each row, over pandas batches; rows of documents that are worked on together where there is of.many."""
    if hasattr(of, "many"):
        return _some(df, schema, of.many)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([of(r) for r in b.itertuples(index=False)], columns=schema.names)

    return df.mapInPandas(run, schema)


#: Documents and icons of a task; bytes of contents that are worked on together.
DOCS_EACH, ICONS_EACH, TOGETHER = 2000, 5000, 1 << 20
#: Tracks whose loops run side by side.
LOOPS = 512


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents; a null text is an empty one."""
    rows = dealt(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", DOCS_EACH)
    return rows.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))


def _some(df: DataFrame, schema: T.StructType, of) -> DataFrame:
    """of(doc_ids, contents) -> a tuple for each, over runs of documents of about TOGETHER bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, raws, held = [], [], 0
            for i, raw in zip(b["doc_id"].tolist(), b["raw"], strict=True):
                ids.append(i)
                raws.append(bytes(raw))
                held += len(raws[-1])
                if held >= TOGETHER:
                    yield pd.DataFrame(of(ids, raws), columns=schema.names)
                    ids, raws, held = [], [], 0
            if ids:
                yield pd.DataFrame(of(ids, raws), columns=schema.names)

    return df.mapInPandas(run, schema)


@query("SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS size, true AS same FROM documents")
def lzh_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed and expanded again."""
    return _some(_docs(spark, sf_dir), _result(doc_id=_L, size=_L, same=_B), lambda ids, raws: [(i, len(x), lzh.expand(p, len(x)) == x) for i, x, p in zip(ids, raws, lzh.pack_many(raws), strict=True)])


@query("SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS size, true AS same FROM documents")
def lzw_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C08."""
    return _each(_docs(spark, sf_dir), _result(doc_id=_L, size=_L, same=_B), lambda r: (r.doc_id, len(r.raw), zips.uncompress(zips.compress(bytes(r.raw))) == bytes(r.raw)))


@query()
def store_or_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method and size that an archive gives a content."""

    def of(ids, raws):
        for i, x, p in zip(ids, raws, lzh.pack_many(raws), strict=True):
            m = lzh.members(lzh.member(f"doc{i}", x, packed=p) + b"\0")[0]
            yield i, m.method, m.packed, m.size, m.crc

    return _some(_docs(spark, sf_dir), _result(doc_id=_L, method=_S, packed=_L, size=_L, crc=_L), lambda ids, raws: list(of(ids, raws)))


def _sectors(raw: bytes) -> list[list[bytes]]:
    parts = [raw[i : i + 512].ljust(512, b"\0") for i in range(0, len(raw), 512)]
    return [parts[i : i + 11] for i in range(0, len(parts), 11)]


@query("SELECT doc_id, ((octet_length(encode(coalesce(text, ''))) + 511) // 512)::BIGINT AS sectors, true AS same FROM documents")
def mfm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents as sectors of tracks, encoded and decoded."""

    def of(r):
        tracks = _sectors(bytes(r.raw))
        same = True
        for t, s in enumerate(tracks):
            got = mfm.recovered(mfm.decode_track(mfm.encode_track(t % 160, s)))
            same &= [got.get((t % 160, k)) for k in range(len(s))] == s
        return r.doc_id, sum(map(len, tracks)), same

    return _each(_docs(spark, sf_dir), _result(doc_id=_L, sectors=_L, same=_B), of)


@query("SELECT doc_id, ((octet_length(encode(coalesce(text, ''))) + 511) // 512)::BIGINT AS found, 0::BIGINT AS lost FROM documents")
def pll_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks as flux series at a speed 3 % off, kept in an SCP image, and decoded by the loop."""
    hz = 1 / mfm.SCP_UNIT

    def counted(ids, raws, loops):
        tracks = [(n, t % 160, s) for n, raw in enumerate(raws) for t, s in enumerate(_sectors(raw))]
        found, lost = [0] * len(ids), [0] * len(ids)
        for at in range(0, len(tracks), LOOPS):
            some, kept = tracks[at : at + LOOPS], []
            for _, t, s in some:
                ticks = mfm.intervals(mfm.encode_track(t, s), 2e-6 * 1.03, hz)
                kept.append(mfm.scp_decode(mfm.scp_encode({t: [ticks]}, 1))[t][0])
            for (n, t, s), cells in zip(some, loops(kept), strict=True):
                got = mfm.recovered(mfm.decode_track(cells))
                good = sum(got.get((t, k)) == d for k, d in enumerate(s))
                found[n], lost[n] = found[n] + good, lost[n] + len(s) - good
        return list(zip(ids, found, lost, strict=True))

    def of(r):
        return counted([r.doc_id], [bytes(r.raw)], lambda kept: [mfm.cells_of(x, 2e-6, hz) for x in kept])[0]

    of.many = lambda ids, raws: counted(ids, raws, lambda kept: mfm.cells_of_many(kept, 2e-6, hz))
    return _each(_docs(spark, sf_dir), _result(doc_id=_L, found=_L, lost=_L), of)


@query("SELECT (user_id % 40)::BIGINT AS track, count(*)::BIGINT AS n, sum(1 + (event_id * 7919) % 99991)::BIGINT AS ticks, true AS same FROM events GROUP BY 1")
def flux_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series through the byte stream; a track is a series and so one task."""
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 40).cast("long").alias("track"), "event_id", (1 + (F.col("event_id") * 7919) % 99991).cast("long").alias("ticks"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        t = g.sort_values("event_id")["ticks"].to_numpy()
        back, _ = mfm.stream_decode(mfm.stream_encode(t))
        return pd.DataFrame({"track": [g["track"].iloc[0]], "n": [len(back)], "ticks": [int(back.sum())], "same": [bool(len(back) == len(t) and (back == t).all())]})

    return rows.groupBy("track").applyInPandas(run, _result(track=_L, n=_L, ticks=_L, same=_B))


#: Files of one volume: a volume is one task, so it holds a bounded run of ids.
PER_VOLUME = 400


def _volume() -> Column:
    return F.concat(F.lit("V"), F.expr(f"doc_id div {PER_VOLUME}").cast("string"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("document "), F.col("doc_id"), F.lit(".text")))
    return read(spark, sf_dir, "documents").select(_volume().alias("volume"), path.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


_FILES = f"(SELECT 'V' || (doc_id // {PER_VOLUME}) AS volume, concat_ws('/', source, lang, 'document ' || doc_id || '.text') AS path, coalesce(text, '') AS text FROM documents)"


def _back(made: DataFrame, volume: Column) -> DataFrame:
    return containers.contents(made).select(volume.alias("volume"), "path", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("digest"), F.col("error").alias("error"))


_SAME = f"SELECT volume, path, octet_length(encode(text))::BIGINT AS size, md5(text) AS digest, NULL::VARCHAR AS error FROM {_FILES} f"


@query(_SAME)
def ffs_image_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to Amiga images and read back."""
    return _back(images.amiga_images(_files(spark, sf_dir)), F.regexp_replace("image", r"\.adf$", ""))


@query(_SAME)
def fat_image_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to FAT32 images, with long names, and read back."""
    return _back(images.fat_images(_files(spark, sf_dir)), F.regexp_replace("image", r"\.img$", ""))


@query(_SAME)
def pfs_image_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to PFS3 images and read back."""
    return _back(images.pfs_images(_files(spark, sf_dir)), F.regexp_replace("image", r"\.hdf$", ""))


@query(_SAME)
def lha_archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in archives, extracted with their checksums."""
    return _back(images.archives(_files(spark, sf_dir)), F.regexp_replace("image", r"\.lha$", ""))


@query(f"""
WITH f AS (SELECT volume, path, octet_length(encode(text)) AS size FROM {_FILES} x),
d AS (SELECT volume, path, size, 1 AS file, 4 AS depth FROM f WHERE false UNION ALL SELECT volume, path, size, 1, 3 FROM f
  UNION SELECT DISTINCT volume, regexp_extract(path, '^(.*)/[^/]*$', 1), 0, 0, 2 FROM f UNION SELECT DISTINCT volume, regexp_extract(path, '^([^/]*)/', 1), 0, 0, 1 FROM f)
SELECT volume || '.adf' AS image, volume, count(*)::BIGINT AS items, sum(file)::BIGINT AS files, sum(size)::BIGINT AS bytes, max(depth)::BIGINT AS deepest, NULL::VARCHAR AS error FROM d GROUP BY volume""")
def inspect_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in each image."""
    return containers.inspect(images.amiga_images(_files(spark, sf_dir)))


@query("""
WITH s AS (SELECT n_regionkey AS image, n_nationkey AS ord, 10 + n_nationkey * 3 AS size FROM nation),
l AS (SELECT *, 2 + coalesce(sum(size) OVER (PARTITION BY image ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, lead(ord) OVER (PARTITION BY image ORDER BY ord) IS NULL AS final FROM s)
SELECT 'R' || image AS image, 'DH' || ord AS name, (low * 1008 * 512)::BIGINT AS start_byte, ((CASE WHEN final THEN 999 ELSE low + size - 1 END - low + 1) * 1008 * 512)::BIGINT AS size FROM l""")
def rdb_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition tables written as blocks, and read from them."""
    from platter.parse import partitions

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ord")
        parts = partitions.assigned([(f"DH{o}", 0x444F5303, int(n)) for o, n in zip(g["ord"], g["size"], strict=True)], 1000)
        return pd.DataFrame({"path": [f"R{g['image'].iloc[0]}"], "content": [partitions.write_disk(partitions.Disk(1000, partitions=parts))]})

    rows = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("image"), F.col("n_nationkey").cast("long").alias("ord"), (F.col("n_nationkey") * 3 + 10).cast("long").alias("size"))
    return containers.partition_table(rows.groupBy("image").applyInPandas(run, images.IMAGE)).select("image", "name", "start_byte", "size")


@query("""
SELECT k AS p_partkey, (1 + k % 9)::BIGINT AS width, (1 + k % 5)::BIGINT AS height, (count(*) FILTER (pen = 0 AND k % 2 = 0))::BIGINT AS n_clear, sum(pen)::BIGINT AS red, sum(pen * 7 % 256)::BIGINT AS blue
FROM (SELECT k, (i * k // 3) % (2 + k % 200) AS pen FROM (SELECT p_partkey::BIGINT AS k, unnest(range((1 + p_partkey % 9) * (1 + p_partkey % 5))) AS i FROM part)) GROUP BY k""")
def colour_icons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour images behind plain icons, written plainly or as runs, and read back."""

    def of(r):
        k = int(r.p_partkey)
        w, h, n = 1 + k % 9, 1 + k % 5, 2 + k % 200
        pens = (np.arange(w * h).reshape(h, w) * k // 3) % n
        pen = np.arange(n)
        form = icons.colour_form(pens, np.stack([pen, 255 - pen, pen * 7 % 256], 1), 0 if k % 2 == 0 else None, k % 3 > 0)
        got = icons.colour_picture(icons.write(icons.Icon(3, default_tool="FORM")) + form).astype(np.int64)
        return k, got.shape[1], got.shape[0], int((got[..., 3] == 0).sum()), int(got[..., 0].sum()), int(got[..., 2].sum())

    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"))
    return _each(dealt(rows, "p_partkey", ICONS_EACH), _result(p_partkey=_L, width=_L, height=_L, n_clear=_L, red=_L, blue=_L), of)


@query("""
SELECT s_suppkey::BIGINT AS s_suppkey, 'old.library' AS old_name, 'lib' || s_suppkey || '.library' AS new_name, (32 + 44 + 24 + 4 * ((length('lib' || s_suppkey || '.library') + 4) // 4))::BIGINT AS size,
  'SYS:' || s_name AS backdrop, 'usa' AS old_keymap FROM supplier""")
def changed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names inside libraries and preferences, changed and read back."""
    code = struct.pack(">I2s12xI2x2I12s", 0x70FF4E75, prefs.RESIDENT, 32, 32, 5, b"old.library")
    longs = len(code) // 4
    library = struct.pack(">8I", prefs.HEADER, 0, 1, 0, 0, longs, prefs.CODE, longs) + code + struct.pack(">6I", prefs.RELOCATIONS, 1, 0, 18, 0, 0x3F2)
    settings = pictures.form("PREF", [("PTRN", bytes(23) + b"\x03RAM"), ("INPT", b"\0\x03usa\0")])

    def of(r):
        new = prefs.Library(library).renamed(f"lib{r.s_suppkey}.library")
        changed, keymap = prefs.keymap(prefs.backdrop(settings, f"SYS:{r.s_name}"), "gb")
        backdrop = dict(pictures.chunks(changed)[1])["PTRN"][prefs.PATTERN_HEAD + 1 :].decode("latin-1")
        return int(r.s_suppkey), prefs.Library(library).name, prefs.Library(new).name, len(new), backdrop, keymap

    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name")
    return _each(rows, _result(s_suppkey=_L, old_name=_S, new_name=_S, size=_L, backdrop=_S, old_keymap=_S), of)
