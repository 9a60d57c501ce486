"""Formats: known vectors, round trips, damage."""

import io
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from platter.codecs import icons, lzh, lzhuf, mfm, pictures, prefs, zips
from platter.functions import checksums, dates, geometry, names, texts, tooling
from platter.operators import chains, images, ranks
from platter.parse import fat, ffs, iso, partitions, pfs
from platter.sources import containers
from platter.sources.blocks import BlockSource
from platter.streaming import captures


def test_name_hashes(spark):
    rows = [("español", 20, 36), ("ESPAÑOL", 20, None), ("français", 47, 71), ("português", 8, 32), ("Prefs", 9, None), ("Disk.info", None, 54), ("", 0, 0)]
    got = spark.createDataFrame(rows, "name string, a int, b int").select("*", names.hash_slot(F.col("name")).alias("x"), names.hash_slot(F.col("name"), international=False).alias("y")).collect()
    for r in got:
        assert r.a in (None, r.x) and r.b in (None, r.y)
        assert ffs.slot_of(r.name, 72, True) == r.x
    assert ffs.slot_of("CheckScreenModeandChipset_Pistorm"[:30], 72, True) == 7


def test_fold(spark):
    got = spark.createDataFrame([("ñàþ÷ÿßa",)], "s string").select(names.fold(F.col("s")).alias("a"), names.fold(F.col("s"), False).alias("b")).first()
    assert (got.a, got.b) == ("ÑÀÞ÷ÿßA", "ñàþ÷ÿßA")


def test_protection(spark):
    rows = [(0, "----rwed"), (0x20, "--p-rwed"), (0x40, "-s--rwed"), (0x27, "--p-r---")]
    df = spark.createDataFrame(rows, "bits long, mask string").select("*", names.protection_mask(F.col("bits")).alias("m"), names.protection_bits(F.col("mask")).alias("b"))
    assert all(r.m == r["mask"] and r.b == r.bits for r in df.collect())
    odd = spark.createDataFrame([("--P-R---",), ("rwed",), ("----rwedx",), ("xxxxxxxx",)], "m string").select(names.protection_bits(F.col("m")).alias("b")).collect()
    assert [r.b for r in odd] == [0x27, None, None, None]


def test_dates(spark):
    t = F.timestamp_seconds(F.lit(252_460_800 + 86_400 + 60))
    day, minute, tick = dates.datestamp(t)
    assert tuple(spark.range(1).select(day, minute, tick).first()) == (1, 1, 0)
    near, cut = dates.datestamp(F.timestamp_micros(F.lit(252_460_801_990_001))), dates.datestamp(F.timestamp_micros(F.lit(252_460_801_990_001)), rounded=False)
    assert tuple(spark.range(1).select(*near, *cut).first()) == (0, 0, 100, 0, 0, 50)
    assert tuple(spark.range(1).select(*dates.datestamp(F.timestamp_seconds(F.lit(0)))).first()) == (0, 0, 0)


def test_checksums():
    assert checksums.crc16_of(b"123456789") == 0xBB3D
    block = partitions.sealed(bytearray(range(256)) * 2)
    assert checksums.long_sum(block) == 0


def test_texts(spark):
    def run(c, text):
        return spark.createDataFrame([(text,)], "t string").select(c(F.col("t")).alias("x")).first().x

    assert run(texts.normalized, "﻿a\r\nb\rc\n") == "a\nb\nc\n"
    assert run(lambda t: texts.replace_line_prefix(t, "Stack ", "stack 9"), "STACK 5\nx\nstack") == "stack 9\nx\nstack"
    assert run(lambda t: texts.insert_before_line(t, "end", "new"), "a\nENDCLI\nend") == "a\nnew\nENDCLI\nend"
    assert run(lambda t: texts.insert_before_line(t, "zz", "new"), "a\nb") == "a\nb"
    assert run(lambda t: texts.regex_replace_lines(t, "(a)(b)", "$1{2}{1}\\$"), "ab\nxab") == "aba$\nxaba$"
    raw = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "b binary").select(texts.decoded(F.col("b")).alias("x")).collect()
    assert [r.x for r in raw] == ["é", "é"]


@pytest.mark.parametrize("content", [b"", b"a", b"a" * 1000, bytes(random.Random(1).randrange(256) for _ in range(4096)), b"\0\x41\x41\x42" * 5000, bytes(i // 700 & 255 for i in range(40_000)), b"two phrases, one " * 800 + b"and another " * 400])
def test_packers(content):
    assert lzh.expand(lzh.pack(content), len(content)) == content
    assert zips.uncompress(zips.compress(content)) == content
    assert pictures.unpack_runs(pictures.pack_runs(content), len(content)) == content
    (m,) = lzh.members(lzh.archive([("dir/x", content)]))
    assert m.path == "dir/x" and lzh.content(lzh.archive([("dir/x", content)]), m) == content
    assert m.method == ("-lh5-" if m.packed < m.size else "-lh0-")


def test_archive_order_and_damage():
    raw = lzh.archive([("b/y", b"2" * 99), ("a\\..\\x", b"1")])
    assert [m.path for m in lzh.members(raw)] == ["a/x", "b/y"]
    broken = bytearray(raw)
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        lzh.content(bytes(broken), lzh.members(bytes(broken))[1])


def test_zip_with_password():
    entry = b"hello " * 50
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("../up", b"x")
        z.writestr("a/b", entry)
    es = {e.name: e for e in zips.entries(made.getvalue())}
    assert zips.content(made.getvalue(), es["a/b"]) == entry and not zips.safe("../up")


@pytest.mark.parametrize("n", [11, 22])
def test_tracks(n):
    sectors = [bytes((s * 13 + i) & 255 for i in range(512)) for s in range(n)]
    cells = mfm.encode_track(3, sectors)
    hz, r = 72e6, np.random.RandomState(1)
    ticks = mfm.intervals(cells, mfm.CELL[n], hz)
    for jitter, speed in ((0, 1), (0.08 if n == 11 else 0.06, 1), (0, 1.05)):
        t = np.rint(ticks * speed + r.uniform(-jitter, jitter, len(ticks)) * mfm.CELL[n] * hz)
        got = mfm.recovered(mfm.decode_track(mfm.cells_of(t, mfm.CELL[n], hz)))
        assert [got.get((3, s)) for s in range(n)] == sectors
    bad = bytearray(cells)
    bad[1500] ^= 0x10
    assert sum(not s.data_ok for s in mfm.decode_track(bytes(bad))) == 1


def test_flux_containers():
    t = np.array([1, 5, 249, 250, 1524, 1525, 70_000, 3, 200_000])
    assert (mfm.stream_decode(mfm.stream_encode(t))[0] == t).all()
    raw = mfm.scp_encode({0: [t, t[:3]], 7: [t[:5], t]}, 2)
    assert mfm.scp_checksum_ok(raw)
    back = mfm.scp_decode(raw)
    assert sorted(back) == [0, 7] and (back[0][0] == t).all() and (back[7][1] == t).all()


def test_disk_from_two_revolutions():
    sectors = [bytes([s]) * 512 for s in range(11)]
    ticks = mfm.intervals(mfm.encode_track(0, sectors), 2e-6, 72e6)
    bad = ticks.copy()
    bad[4000] += 40
    image, found = mfm.disk_image({0: [bad, ticks]}, 72e6)
    assert len(image) == 901_120 and found[0] == 11 and found[1] == 0 and image[:5632] == b"".join(sectors)


def test_pictures():
    head = struct.pack(">HHhhBBBBHBBhh", 4, 2, 0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0)
    raw = pictures.form("ILBM", [("BMHD", head), ("CMAP", bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])), ("BODY", bytes([0b10100000, 0, 0b01100000, 0]))])
    p = pictures.ilbm(raw)
    assert p.rgba[0, :, :3].tolist() == [[255, 0, 0], [0, 255, 0], [0, 0, 255], [0, 0, 0]] and not p.rgba[1].any()
    assert pictures.chunks(raw[:-2])[1][-1][0] == "BODY"


FILES = [("Prefs/env/a.txt", b"hello"), ("Empty name", b""), ("big", bytes(random.Random(2).randrange(256) for _ in range(90_000))), ("español", b"x"), *[(f"d/f{i}", b"y" * i) for i in range(120)]]


@pytest.mark.parametrize(("kind", "size", "total"), [(0x444F5303, 512, 4000), (0x444F5300, 512, 4000), (0x444F5305, 2048, 2000), (0x444F5301, 512, 300_000)])
def test_amiga_volumes(kind, size, total):
    entries = [ffs.Entry(p, False, c, 5, (1, 2, 3), "note") for p, c in FILES] + [ffs.Entry("Folder", True)]
    raw = ffs.write(ffs.Volume("Work", kind, size, total, entries))
    assert ffs.boot_valid(raw) and raw == ffs.write(ffs.Volume("Work", kind, size, total, entries))
    v = ffs.read(raw, kind, size)
    got = {e.path: e for e in v.entries}
    assert v.name == "Work" and not v.problems and set(got) == {p for p, _ in FILES} | {"Folder", "Prefs", "Prefs/env", "d"}
    assert all(got[p].content == c and got[p].protection == 5 and got[p].date == (1, 2, 3) and got[p].comment == "note" for p, c in FILES)
    broken = bytearray(raw)
    at = got["big"].block * size
    broken[at + 30] ^= 1
    assert len(ffs.read(bytes(broken), kind, size).problems) == 1
    with pytest.raises(ValueError):
        ffs.write(ffs.Volume("Work", kind, size, 100, entries))


def test_golden_partitions():
    parts = partitions.assigned([("SDH0", 0x444F5303, 4162), ("SDH1", 0x444F5307, 6208), ("SDH2", 0x444F5303, 5)], 11413)
    binary = bytes((i * 31 & 255) ^ 0xA5 for i in range(30_532))
    raw = partitions.write_disk(partitions.Disk(11482, partitions=parts, systems=[partitions.FileSystem(0x444F5303, 0x002F0004, binary)]))
    disk = partitions.read_disk(raw)
    assert [(p.name, p.low, p.high, p.start, p.start + p.size - 1) for p in disk.partitions] == [
        ("SDH0", 2, 4163, 1_032_192, 2_149_023_743),
        ("SDH1", 4164, 10371, 2_149_023_744, 5_352_947_711),
        ("SDH2", 10372, 11412, 5_352_947_712, 5_890_203_647),
    ]
    assert disk.systems[0].binary == binary and -(-len(binary) // 492) == 63
    with pytest.raises(ValueError):
        partitions.assigned([("A", 1, 0), ("B", 1, 5)], 100)
    assert partitions.pc_slots(partitions.pc_table([(True, 12, 2048, 99)]))[0] == partitions.Slot(0, True, 12, 2048, 99)
    assert partitions.pc_slots(bytes(512)) == []


def test_fat():
    v = fat.blank(40_000, "work", 1)
    v.entries = [fat.Entry(p, False, c) for p, c in FILES] + [fat.Entry("FOLDER", True)]
    back = fat.read(fat.write(v))
    got = {e.path: e for e in back.entries}
    assert back.label == "WORK" and all(got[p].content == c and not got[p].note for p, c in FILES) and got["FOLDER"].is_dir
    assert back.free == v.layout.clusters - sum(max(1, -(-len(e.content) // 512)) for e in got.values() if not e.is_dir and e.content) - sum(1 for e in got.values() if e.is_dir) - 1 - 24 + 24 or back.free > 0
    assert fat.short("Long file name.text") == b"LONGFILETEX" and fat.shown(fat.short("a.b")) == "A.B"
    with pytest.raises(ValueError):
        fat.layout(bytes(512))


def test_iso():
    def record(name, extent, size, flags):
        n = 33 + len(name) + (len(name) + 1) % 2
        r = bytearray(n)
        r[0] = n
        struct.pack_into("<I", r, 2, extent)
        struct.pack_into("<I", r, 10, size)
        r[18:25] = bytes([124, 2, 3, 4, 5, 6, 4])
        r[25], r[32] = flags, len(name)
        r[33 : 33 + len(name)] = name
        return bytes(r)

    root = record(b"\0", 20, 2048, 2) + record(b"\1", 20, 2048, 2) + record(b"SUB", 21, 2048, 2) + record(b"READ.ME;1", 22, 5, 0)
    pvd = bytearray(2048)
    pvd[:6] = b"\1CD001"
    pvd[40:72] = b"DISC".ljust(32)
    pvd[156:190] = record(b"\0", 20, 2048, 2)
    raw = bytes(16 * 2048) + bytes(pvd) + (b"\xffCD001".ljust(2048, b"\0")) + bytes(2 * 2048) + root.ljust(2048, b"\0") + record(b"X.;2", 22, 3, 0).ljust(2048, b"\0") + b"hello".ljust(2048, b"\0")
    name, found = iso.read(raw)
    assert name == "DISC" and [(e.path, e.is_dir, e.size) for e in found] == [("SUB", True, 2048), ("READ.ME", False, 5), ("SUB/X", False, 3)]
    assert iso.content(raw, found[1]) == b"hello" and found[1].modified.hour == 3


def test_containers(spark, tmp_path):
    disk = partitions.Disk(40, partitions=partitions.assigned([("DH0", 0x444F5303, 20), ("DH1", 0x50445303, 0)], 40))
    per = 16 * 63
    body = bytearray(40 * per * 512)
    body[: 2 * per * 512] = partitions.write_disk(disk)
    image = ffs.write(ffs.Volume("Work", 0x444F5303, 512, 20 * per, [ffs.Entry(p, False, c) for p, c in FILES]))
    body[2 * per * 512 : 2 * per * 512 + len(image)] = image
    made = {"a.hdf": bytes(body), "b.lha": lzh.archive(FILES), "c.adf": images.amiga_image("V", FILES), "d.img": images.fat_image("F", FILES), "e.adf": b"junk" * 200}
    for k, raw in made.items():
        (tmp_path / k).write_bytes(raw)
    files = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("path", F.regexp_extract("path", r"([^/]*)$", 1))
    rows = containers.contents(files).collect()
    for k in ("a.hdf", "b.lha", "c.adf", "d.img"):
        assert {r.path: bytes(r.content) for r in rows if r.image == k and r.content is not None} == dict(FILES)
    errors = {(r.image, r.volume) for r in rows if r.error}
    assert errors == {("a.hdf", "DH1"), ("e.adf", "BOOT")}
    look = {(r.image, r.volume): r for r in containers.inspect(files).collect()}
    assert look["c.adf", "V"].files == len(FILES) and look["c.adf", "V"].bytes == sum(len(c) for _, c in FILES)
    assert [(r.name, r.start_byte) for r in containers.partition_table(files).where("image = 'a.hdf'").collect()] == [("DH0", 2 * per * 512), ("DH1", 22 * per * 512)]
    assert [r.b for r in files.select(containers.is_container(F.col("path")).alias("b")).collect()] == [True] * 5
    spark.dataSource.register(BlockSource)
    blocks = spark.read.format("diskblocks").option("path", str(tmp_path / "a.hdf")).option("blocks_per_task", 5000).load()
    assert blocks.rdd.getNumPartitions() == -(-40 * per // 5000)
    assert blocks.where("substr(data, 1, 4) = X'52445348' or substr(data, 1, 4) = X'50415254'").count() == 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    some = spark.read.format("diskblocks").option("path", str(tmp_path / "a.hdf")).option("pushdown", "true").load().where("lba >= 1 and lba < 3")
    assert [(r.lba, bytes(r.data)) for r in some.collect()] == [(1, bytes(body[512:1024])), (2, bytes(body[1024:1536]))]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_ranks_and_chains(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r.v == r["rank"] for r in ranks.with_rank(df, "v").collect())
    runs = ranks.islands(spark.createDataFrame([(1, x) for x in (1, 2, 3, 7, 8, 20)], "k int, v long"), ["k"], "v").collect()
    assert sorted((r.first, r.last, r.n) for r in runs) == [(1, 3, 3), (7, 8, 2), (20, 20, 1)]
    links = spark.createDataFrame([*((i, i + 1 if i < 299 else None) for i in range(300)), (500, 501), (501, 500), (900, None)], "node long, next long")
    got = {r.node: (r.root, r.hop) for r in chains.hops(links).collect()}
    assert got == {**{i: (0, i) for i in range(300)}, 900: (900, 0)}


@pytest.mark.parametrize("content", [b"", b"a", b"abc" * 3000, bytes(random.Random(4).randrange(256) for _ in range(60_000)), b"adaptive trees count up and are rebuilt " * 2000])
def test_adaptive_codes(content):
    assert lzhuf.expand(lzhuf.pack(content), len(content)) == content
    assert lzh.decode("-lh1-", lzhuf.pack(content), len(content)) == content


def test_icons():
    image = struct.pack(">hhhhhIBBI", 0, 0, 20, 3, 2, 1, 0, 0, 0) + bytes(range(24))
    raw = icons.write(icons.Icon(4, 8192, 10, None, "SYS:Tool", ["A=1", "DONOTWAIT"], b"d" * 56, [(20, 3, 2, image)]))
    icon = icons.read(raw)
    assert (icon.kind_name, icon.stack, icon.x, icon.y, icon.default_tool, icon.tool_types) == ("project", 8192, 10, None, "SYS:Tool", ["A=1", "DONOTWAIT"])
    assert icons.write(icon) == raw and icons.picture(icon).shape == (3, 20, 4)
    new = icons.read(icons.changed(raw, stack=99, tool_types=["X"], default_tool="Work:Other", kind=3))
    assert (new.stack, new.tool_types, new.default_tool, new.kind_name, new.images) == (99, ["X"], "Work:Other", "tool", icon.images)
    with pytest.raises(ValueError):
        icons.read(b"x" * 100)


def colour_icon(image: bytes, w: int, h: int) -> bytes:
    """An icon with a plain image of one plane, and behind it the given colour image."""
    plain = struct.pack(">hhhhhIBBI", 0, 0, 8, 8, 1, 1, 0, 0, 0) + b"\xff" * 16
    face = bytes([w - 1, h - 1, 0, 0, 0, 11])
    body = b"ICONFACE" + struct.pack(">I", 6) + face + b"IMAG" + struct.pack(">I", len(image)) + image + b"\0" * (len(image) % 2)
    return icons.write(icons.Icon(3, images=[(8, 8, 1, plain)])) + b"FORM" + struct.pack(">I", len(body)) + body


def test_colour_icons():
    colours = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    want = [[255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [9, 9, 9, 0]]
    # plain, eight bits a pixel, pen 3 is clear
    raw = colour_icon(bytes([3, 3, 3, 0, 0, 8, 0, 3, 0, 11, 0, 1, 2, 3]) + colours, 2, 2)
    assert icons.colour_picture(raw).reshape(-1, 4).tolist() == want
    # packed, two bits a pixel: three literals (1, 2, 3), nothing, five times 0; the bits run on across bytes
    stream = "00000010" "01" "10" "11" "10000000" "11111100" "00"
    pens = int(stream.ljust(40, "0"), 2).to_bytes(5, "big")
    raw = colour_icon(bytes([0, 3, 3, 1, 0, 2, 0, 4, 0, 11]) + pens + colours, 4, 2)
    got = icons.colour_picture(raw)
    assert got.shape == (2, 4, 4) and got[0, 0].tolist() == want[1] and got[0, 2].tolist() == [9, 9, 9, 255]
    assert got.reshape(-1, 4)[3:].tolist() == [[255, 0, 0, 0]] * 5
    for bad in (raw[:110], colour_icon(bytes([0, 3, 3, 0, 0, 8, 0, 99, 0, 11]) + pens, 4, 2), colour_icon(bytes([0, 3, 1, 0, 0, 8, 0, 7, 0, 11]) + bytes(20), 4, 2)):
        assert icons.colour_picture(bad) is None
    r = np.random.RandomState(1)
    for packed in (False, True):
        for n, shape in ((2, (1, 1)), (5, (7, 9)), (256, (200, 3)), (1, (30, 30))):
            pens, rgb = r.randint(0, n, shape), r.randint(0, 256, (n, 3))
            pens[:, : shape[1] // 2] = 0
            got = icons.colour_picture(b"\0" * 78 + icons.colour_form(pens, rgb, 0, packed))
            assert (got[..., :3] == rgb[pens]).all() and ((got[..., 3] == 0) == (pens == 0)).all()


def test_changed_preferences():
    raw = pictures.form("PREF", [("PRHD", b"abcdef"), ("PTRN", bytes(range(23)) + b"\x03SYS"), ("PTRN", bytes(24))])
    new = prefs.backdrop(raw, "Work:A")
    assert pictures.chunks(new)[1] == [("PRHD", b"abcdef"), ("PTRN", bytes(range(23)) + b"\x06Work:A"), ("PTRN", bytes(24))]
    assert struct.unpack_from(">I", new, 4)[0] == len(new) - 8
    raw = pictures.form("PREF", [("INPT", b"\0\x03usa\0rest")])
    new, old = prefs.keymap(raw, "gb1x")
    assert old == "usa" and pictures.chunks(new)[1] == [("INPT", b"\0\x04gb1xrest")]
    for f, x in ((prefs.backdrop, raw), (prefs.keymap, pictures.form("PREF", [])), (prefs.keymap, b"FORM")):
        with pytest.raises((ValueError, struct.error)):
            f(x, "a")


def test_renamed_library():
    longs = lambda *x: struct.pack(f">{len(x)}I", *x)
    # a jump, the resident structure at 4 with its name pointer at 18, a second pointer at 24, another value at 28, the name at 32
    code = longs(0x70FF4E75) + b"\x4a\xfc" + bytes(12) + longs(32) + bytes(2) + longs(32, 5) + b"old.library\0"
    rest = longs(0x3EC, 2, 0, 18, 28, 1, 1, 24, 1, 0, 24, 0, 0x3F2)
    raw = longs(0x3F3, 0, 1, 0, 0, len(code) // 4, 0x3E9, len(code) // 4) + code + rest
    library = prefs.Library(raw)
    assert library.name == "old.library" and library.places.tolist() == [18, 28, 24]
    new = library.renamed("other.library")
    want = bytearray(code)
    for at in (18, 24):
        struct.pack_into(">I", want, at, len(code))
    size = len(code) // 4 + 4
    assert new == longs(0x3F3, 0, 1, 0, 0, len(code) // 4, 0x3E9, size) + bytes(want) + b"other.library\0\0\0" + rest
    assert prefs.Library(new).name == "other.library"
    assert struct.unpack_from(">I", library.renamed("other.library", header=True), 20)[0] == size
    # without relocations the pointer alone is changed
    assert prefs.Library(prefs.Library(raw[: -len(rest)] + longs(0x3F2)).renamed("x")).name == "x"
    for bad in (b"", raw[:40], longs(1, 2, 3), raw.replace(b"\x4a\xfc", b"\0\0")):
        with pytest.raises(ValueError):
            prefs.Library(bad).renamed("x")


def test_tools(spark):
    rows = [("DH0:dos3", 0x444F5303, 0, 1), ("DH0:PDS3:100:1:-5:4", 0x50445303, 100, 4), ("DH0:0x444F5307:5", 0x444F5307, 5, 1), ("DH0:dos3:1:0:0:3", None, None, None), (":dos3", None, None, None), ("DH0", None, None, None), ("DH0:what", None, None, None)]
    got = spark.createDataFrame(rows, "t string, a long, b long, c long").select("*", tooling.partition_spec(F.col("t")).alias("s")).collect()
    for r in got:
        assert (r.s.dos_type, r.s.cylinders, r.s.sectors_per_block) == (r.a, r.b, r.c) if r.a else r.s is None
    one = spark.createDataFrame([("$VER: FFS 47.4 (1.1.99)", "é\u0041b\u3042")], "v string, n string").select(tooling.version_of(F.col("v")).alias("v"), tooling.ascii_name(F.col("n")).alias("n")).first()
    assert (one.v, one.n) == (0x002F0004, "eAb")
    sizes = spark.createDataFrame([(5_925_814_272,), (901_120,)], "s long").select(tooling.size_label(F.col("s")).alias("x")).collect()
    assert [r.x for r in sizes] == ["5.5 GiB (5.9 GB)", "1 MiB"]


def test_stream_of_captures(spark, tmp_path):
    rows = [("d", 0, s, a, a > 0, bytes([s, a]), f"2024-01-01 00:0{a}:00") for s in range(11) for a in range(3)]
    for a in range(3):
        df = spark.createDataFrame([r for r in rows if r[3] == a], "disk string, track int, sector int, attempt int, valid boolean, data binary, t string")
        df.select("disk", "track", "sector", "attempt", "valid", "data", F.to_timestamp("t").alias("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = captures.recovered(captures.arriving(spark, str(tmp_path / "in"), 1))
    q = kept.writeStream.format("memory").queryName("kept_sectors").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("kept_sectors").collect()
    assert len(got) == 11 and {r.sector for r in got} == set(range(11)) and all(r.valid for r in got)


def test_pfs_volumes():
    entries = [pfs.Entry(p, False, c, 0x12345, (1, 2, 3), "note") for p, c in FILES] + [pfs.Entry("Folder", True)] + [pfs.Entry(f"many/a rather long file name number {i}", False, b"z") for i in range(700)]
    raw = pfs.write(pfs.Volume("Work", 6000, entries))
    v = pfs.read(raw)
    got = {e.path: e for e in v.entries}
    assert v.name == "Work" and v.sectors == 6000 and not v.problems and len(got) == len(entries) + 4
    assert all(got[e.path].content == e.content and got[e.path].is_dir == e.is_dir for e in entries)
    assert all(got[p].protection == 0x12345 and got[p].date == (1, 2, 3) and got[p].comment == "note" for p, _ in FILES)
    assert raw == pfs.write(pfs.Volume("Work", 6000, entries))
    broken = bytearray(raw)
    broken[raw.index(b"DB\0\0")] = 0
    assert pfs.read(bytes(broken)).problems
    with pytest.raises(ValueError):
        pfs.write(pfs.Volume("Work", 300, entries))
    with pytest.raises(ValueError):
        pfs.read(bytes(4096))


def test_long_names():
    name = "CheckScreenModeandChipset_Pistorm with many more letters than thirty"
    raw = ffs.write(ffs.Volume("Long", 0x444F5307, 2048, 500, [ffs.Entry(f"d/{name}", False, b"x", 1, (4, 5, 6))]))
    e = ffs.read(raw, 0x444F5307, 2048).entries[-1]
    assert (e.path, e.content, e.date) == (f"d/{name}", b"x", (4, 5, 6))
    short = ffs.read(ffs.write(ffs.Volume("S", 0x444F5303, 512, 2000, [ffs.Entry(name, False, b"x")])), 0x444F5303).entries[0]
    assert short.path == name[:30]


def test_reserved_blocks(spark):
    assert spark.range(1).select(geometry.reserved_blocks(F.lit(3_984_624)).alias("x")).first().x == 41_664


def test_replaced_chunk():
    raw = pictures.form("PREF", [("PRHD", b"123456"), ("PTRN", b"abc"), ("PTRN", b"d")])
    new = pictures.replaced(raw, "PTRN", b"longer one", 1)
    assert pictures.chunks(new) == ("PREF", [("PRHD", b"123456"), ("PTRN", b"abc"), ("PTRN", b"longer one")])
    assert struct.unpack_from(">I", new, 4)[0] == len(new) - 8
    with pytest.raises(ValueError):
        pictures.replaced(raw, "NONE", b"")


def test_all_tracks_of_a_long_text_are_found(monkeypatch):
    """More tracks than a hundred images hold; the codec is left out, for speed."""
    from types import SimpleNamespace

    from platter.plans import images

    same = lambda x, *_: x
    codec = SimpleNamespace(SCP_TRACKS=168, SCP_UNIT=25e-9, encode_track=lambda t, s: {(t, k): d for k, d in enumerate(s)}, intervals=same, scp_encode=same, cells_of=same, decode_track=same, recovered=same)
    codec.scp_decode = lambda kept: {t: x for t, x in kept.items()}
    monkeypatch.setattr(images, "mfm", codec)
    monkeypatch.setattr(images, "_docs", lambda *_: None)
    monkeypatch.setattr(images, "_each", lambda docs, schema, of: of)
    sectors = (168 * 100 + 1) * 11
    assert images.pll_decode(None, "")(SimpleNamespace(doc_id=1, raw=bytes(sectors * 512))) == (1, sectors, 0)


def test_packed_cells():
    assert mfm.pack_cells(b"\xa5") == bytes([0b10011001, 0b01100110, 0]) and mfm.pack_cells(b"") == b"\0"
    assert mfm.unpack_cells(bytes([0b10011001, 0b01100110, 0])) == b"\xa5"
    assert mfm.unpack_cells(bytes([0b10011011])) == b"\xa0"  # a code of three ends it too


def test_checksums_by_blocks():
    import random

    from platter.functions import checksums

    r = random.Random(4)
    raw = [r.randbytes(n) for n in (0, 1, 63, 64, 65, 127, 128, 129, 1000, 5000)] + [b"\0" * 200, b"123456789"]
    assert checksums.crc16_many(raw).tolist() == [checksums.crc16_of(x) for x in raw]
    assert checksums.crc16_of(b"123456789") == 0xBB3D


def test_members_are_stored_or_packed():
    import random

    r = random.Random(2)
    for content in (b"", b"a", b"the same words " * 400, r.randbytes(3000)):
        raw = lzh.archive([("f", content)])
        m = lzh.members(raw)[0]
        assert m.size == len(content) and m.packed <= m.size and (m.method == "-lh0-") == (m.packed == m.size)


def test_extracted_files(spark, tmp_path):
    from platter.operators import extract

    rows = [("a/b.txt", b"x", "line"), ("../../c", b"", None), ("d", None, None), ("", b"no", None)]
    df = spark.createDataFrame(rows, "path string, content binary, sidecar string").repartition(2)
    got = extract.to_folder(df, f"file://{tmp_path}/out").collect()
    assert sorted((r.path, r["size"]) for r in got) == [("a/b.txt", 1), ("c", 0), ("d", 0)]
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert found == {"a/b.txt": b"x", "a/b.txt.uaem": b"line", "c": b"", "d": b""}


def test_rings_and_lists(spark):
    from platter.operators.chains import hops

    links = [(i, i + 1) for i in range(1, 7)] + [(7, None)] + [(100 + i, 100 + (i + 1) % 3) for i in range(3)]
    got = {r.node: (r.root, r.hop) for r in hops(spark.createDataFrame(links, "node long, next long")).collect()}
    assert got == {i: (1, i - 1) for i in range(1, 8)}


def test_fat_table_that_is_an_entry_short():
    for sectors in range(32 + 40_000, 32 + 40_130):
        p = fat.blank(sectors, "x", 1).layout
        assert 4 * (p.clusters + 2) <= p.fat_sectors * p.sector
    sectors = next(n for n in range(32 + 5000, 32 + 5130) if 4 * (n - 32) % 520 == 516)
    v = fat.blank(sectors, "x", 1)
    v.entries = [fat.Entry(p, False, c) for p, c in FILES]
    assert {e.path: e.content for e in fat.read(fat.write(v)).entries if not e.is_dir} == dict(FILES)


def test_volume_numbers_of_large_keys(spark, tmp_path):
    import datetime

    import duckdb

    from platter.plans import catalog

    rows = [(k, datetime.datetime(1995, 3, 17)) for k in (1, 270_000, 271_000, 600_000, 36_000_000, 10**9)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = c.execute(catalog.ORACLE_SQL["volume_numbers"]).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["volume_numbers"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert spark.range(1).select(geometry.reserved_blocks(F.lit(10**10)).alias("x")).first().x == geometry.RESERVED_MOST


def test_costly_rows_of_one_file_are_dealt_out(spark, tmp_path):
    from platter.plans import catalog

    spark.range(12_000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert catalog.QUERIES["colour_icons"](spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_loops_side_by_side():
    rng = np.random.default_rng(3)

    def alone(ticks: np.ndarray) -> list[int]:
        now, out = 2e-6, []
        for t in (ticks / 40e6).tolist():
            n = max(1, int(t / now + 0.5))
            out += [0] * (n - 1) + [1]
            now = min(max(now + mfm.GAIN * (t / n - now), 2e-6 * mfm.SLOWEST), 2e-6 * mfm.FASTEST)
        return out

    series = [rng.integers(1, 500, n) for n in (3000, 0, 1, 1024, 1025, 7)] + [np.array([0, 10**6, 3])]
    assert [x.tolist() for x in mfm.cells_of_many(series, 2e-6, 40e6)] == [alone(x) for x in series]
    words = struct.pack(">HHHHHH", 1, 0, 1, 0, 5, 0) + struct.pack(">HH", 0, 1)
    assert mfm.scp_words(np.array([1, 65536, 65541, 131072])) == words


def test_trees_with_names_that_listings_hide(spark, tmp_path):
    import duckdb

    from platter.plans import catalog

    rows = [(1, "a", "en", "_src"), (2, "", "de", ".src"), (3, None, "de", "50%41 + 1"), (801, "x" * 5000, "fr", "src2"), (802, "b", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in catalog.QUERIES["extract_tree"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(c.execute(catalog.ORACLE_SQL["extract_tree"]).fetchall())


def test_images_of_a_batch_are_read_one_at_a_time():
    import tracemalloc

    import pyarrow as pa

    raw = images.fat_image("F", [("a", b"x" * 2_000_000)])
    batch = pa.RecordBatch.from_arrays([pa.array([f"{k}.img" for k in range(30)]), pa.array([raw] * 30)], ["path", "content"])
    seen = []

    def of(path, content):
        seen.append(len(content))
        yield (path, len(content))

    tracemalloc.start()
    assert sum(len(b) for b in containers._each(iter([batch]), ["path", "n"], [pa.string(), pa.int64()], of)) == 30
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == [len(raw)] * 30 and most < 4 * len(raw)


def test_long_z_files():
    import time

    content = random.Random(8).randbytes(600_000)
    began = time.process_time()
    raw = zips.compress(content)
    assert time.process_time() - began < 6  # bits held as one number took time with the square of the length
    assert zips.uncompress(raw) == content
    assert checksums.crc16_of(zips.compress(b"the same words " * 3000)) == 60268


def test_packed_together_as_alone():
    r = random.Random(6)
    contents = [b"", b"a", b"abc", b"a" * 70_000, b"the same words " * 400, r.randbytes(9000), bytes(r.choices(b"ab", k=90_000))]
    packed = lzh.pack_many(contents)
    assert packed == [lzh.pack(x) for x in contents]
    assert [lzh.expand(p, len(x)) for p, x in zip(packed, contents)] == contents
    assert [checksums.crc16_of(p) for p in packed] == [0, 4332, 47497, 41531, 4963, 6175, 6959]  # of the packer that took a byte at a time


def test_cells_are_packed_a_content_at_a_time(spark, tmp_path):
    from platter.plans import catalog

    spark.range(5000).selectExpr("id AS doc_id", "'text' AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("packed_cells", "lzh_roundtrip", "lzw_roundtrip", "store_or_pack", "mfm_roundtrip", "pll_decode"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_overflow_words_without_sums_of_islands(spark, tmp_path):
    import duckdb

    from platter.plans import catalog

    r = random.Random(3)
    rows = [(k // 3, r.choice([0, 65536, 3, 1, 2, 4, 65532]), r.randrange(4), k % 3 + 1) for k in range(3000)] + [(5000, 3, 99, 1), (5001, 7, 99, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = catalog.QUERIES["overflow_words"](spark, str(tmp_path))
    assert sorted(tuple(x) for x in got.collect()) == sorted(c.execute(catalog.ORACLE_SQL["overflow_words"]).fetchall())
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_volumes_are_dealt_out(spark):
    files = spark.range(6000).selectExpr("concat('V', id div 400) AS volume", "concat('f', id) AS path", "cast('x' AS binary) AS content")
    assert images.amiga_images(files.coalesce(1)).rdd.getNumPartitions() == 3
