"""Smaller text and number functions of the tools."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import ASCII_LOWER, ASCII_UPPER, protection_bits


def file_system_name(dos_type: Column) -> Column:
    """The family of a disk type."""
    head, tail = F.shiftright(dos_type, 8), dos_type.bitwiseAND(F.lit(255).cast("long"))
    return (
        F.when((head == 0x444F53) & tail.isin(0, 2, 4), "OFS")
        .when((head == 0x444F53) & tail.isin(6, 7), "FFS long names")
        .when(head == 0x444F53, "FFS")
        .when(head.isin(0x504653, 0x504453), "PFS3")
        .otherwise("unknown")
    )


def parse_dos_type(text: Column) -> Column:
    """DOS1, DOS3, DOS5, DOS7 and PDS3 in either case, or a number in hexadecimal; else null."""
    up = F.translate(text, ASCII_LOWER, ASCII_UPPER)
    known = {"DOS1": 0x444F5301, "DOS3": 0x444F5303, "DOS5": 0x444F5305, "DOS7": 0x444F5307, "PDS3": 0x50445303}
    out = F.when(up.rlike("^(0X)?[0-9A-F]{1,8}$"), F.conv(F.regexp_replace(up, "^0X", ""), 16, 10).cast("long"))
    for name, value in known.items():
        out = F.when(up == name, F.lit(value).cast("long")).otherwise(out)
    return out


def partition_spec(text: Column) -> Column:
    """name:dostype[:cylinders[:boot[:priority[:sectors of a block]]]] as a struct; null without a name or type, or where the last
    part is no power of two. Other numbers that cannot be read are 0. (F10)"""
    parts = F.split(text, ":")
    number = lambda i: F.coalesce(F.when(F.get(parts, F.lit(i)).rlike("^[+-]?[0-9]{1,10}$"), F.get(parts, F.lit(i)).cast("long")), F.lit(0).cast("long"))
    block = F.when((F.size(parts) > 5) & (F.get(parts, F.lit(5)) != ""), number(5)).otherwise(F.lit(1).cast("long"))
    made = F.struct(
        F.get(parts, F.lit(0)).alias("name"),
        parse_dos_type(F.get(parts, F.lit(1))).alias("dos_type"),
        number(2).alias("cylinders"),
        F.coalesce(F.get(parts, F.lit(3)), F.lit("0")).isin("1", "boot").alias("bootable"),
        number(4).alias("priority"),
        block.alias("sectors_per_block"),
    )
    good = (F.size(parts) >= 2) & (F.get(parts, F.lit(0)) != "") & parse_dos_type(F.get(parts, F.lit(1))).isNotNull() & (block > 0) & (block.bitwiseAND(block - 1) == 0)
    return F.when(good, made)


def version_of(text: Column) -> Column:
    """major * 65536 + minor of the first number pair within 128 characters behind `$VER:`; null without one."""
    near = F.regexp_extract(text, r"(?s)\$VER:(.{0,128})", 1)
    major, minor = F.regexp_extract(near, r"(\d+)\.(\d+)", 1), F.regexp_extract(near, r"(\d+)\.(\d+)", 2)
    return F.when(major != "", major.cast("long") * 65536 + minor.cast("long"))


def size_label(size: Column) -> Column:
    """GiB and GB with one decimal from a GiB on, else whole MiB; exact halves go to the even digit."""
    big = F.format_string("%.1f GiB (%.1f GB)", F.bround(size / float(1 << 30), 1), F.bround(size / 1e9, 1))
    return F.when(size >= 1 << 30, big).otherwise(F.format_string("%.0f MiB", F.bround(size / float(1 << 20), 0)))


@F.pandas_udf(T.StringType())  # type: ignore[call-overload]
def _ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if ord(c) < 128))


def ascii_name(name: Column) -> Column:
    """Compatibility-decomposed, without what is not ASCII; null where nothing is left or nothing changes."""
    out = _ascii(name)
    return F.when((out != "") & (out != name), out)


def sidecar_line(mask: Column, ts: Column, comment: Column) -> Column:
    """The line of a sidecar: mask, time in UTC with hundredths, comment; without a time the beginning of 1970."""
    when = F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SS"), F.lit("1970-01-01 00:00:00.00"))
    return F.concat(mask, F.lit(" "), when, F.lit(" "), F.coalesce(comment, F.lit("")))


def parse_sidecar(text: Column) -> Column:
    """mask, modified and comment of a sidecar's first line, null if the mask is none; a line of fewer than three parts has only
    the mask. (S43)"""
    line = F.regexp_replace(F.substring_index(text, "\n", 1), "\r$", "")
    date = F.regexp_extract(line, r"^\S{8} (\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d\d)", 1)
    rest = F.regexp_extract(line, r"^\S{8} \S+ \S+ ?(.*)$", 1)
    mask = F.regexp_extract(line, r"^(\S*)", 1)
    made = F.struct(mask.alias("mask"), F.when(date != "", F.to_timestamp(date, "yyyy-MM-dd HH:mm:ss.SS")).alias("modified"), F.trim(rest).alias("comment"))
    return F.when(protection_bits(mask).isNotNull(), made)
