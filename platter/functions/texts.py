"""Transforms of text files and content classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import ASCII_LOWER, ASCII_UPPER


def normalized(text: Column) -> Column:
    """Without a byte order mark at the start, and with LF for CR LF and lone CR."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _lower(x: Column) -> Column:
    return F.translate(x, ASCII_UPPER, ASCII_LOWER)


def replace_line_prefix(text: Column, prefix: str, line: str) -> Column:
    """Whole lines that begin with the prefix, in any case, become `line`. (F32)"""
    low = prefix.translate(str.maketrans(ASCII_UPPER, ASCII_LOWER))
    return F.array_join(F.transform(lines(text), lambda x: F.when(_lower(x).startswith(low), F.lit(line)).otherwise(x)), "\n")


def insert_before_line(text: Column, pattern: str, line: str) -> Column:
    """`line` before the first line that begins with a match of the pattern, in any case; once, and only if there is one."""
    split = lines(text)
    hit = F.array_position(F.transform(split, lambda x: x.rlike(f"(?i)^(?:{pattern})")), F.lit(True)).cast("int")
    return F.when(hit > 0, F.array_join(F.concat(F.slice(split, F.lit(1), hit - 1), F.array(F.lit(line)), F.slice(split, hit, F.size(split))), "\n")).otherwise(text)


def regex_replace_lines(text: Column, pattern: str, replacement: str, ignore_case: bool = False) -> Column:
    """Every match on every line becomes the replacement, in which {1} to {9} and $1 to $9 are the groups and a backslash makes
    the next character plain. (F34)"""
    to = re.sub(r"\{([1-9])\}", r"$\1", replacement)
    return F.array_join(F.transform(lines(text), lambda x: F.regexp_replace(x, ("(?i)" if ignore_case else "") + pattern, to)), "\n")


#: Bytes that count against a text: control codes of both halves but tab, LF, FF and CR. Looked for in the first HEAD bytes; the
#: limit is part of the test.
CONTROL = r"[\x00-\x08\x0B\x0E-\x1F\x7F-\x9F]"
HEAD = 65_536


def is_textual(content: Column) -> Column:
    """Less than 5 % control codes; an empty content is a text."""
    head = F.left(F.decode(content, "ISO-8859-1"), F.lit(HEAD))
    return (F.octet_length(content) == 0) | (F.regexp_count(head, F.lit(CONTROL)) * 20 < F.char_length(head))


def content_kind(content: Column) -> Column:
    """What a preview would show: a picture, an icon, text, or bytes."""
    starts = lambda x: F.substring(content, 1, len(x) // 2) == F.unhex(F.lit(x))
    ilbm = starts("464F524D") & (F.substring(content, 9, 4).isin(bytearray(b"ILBM"), bytearray(b"PBM ")))
    return F.when(ilbm, "bitmap").when(starts("E310"), "icon").when(is_textual(content), "text").otherwise("hex")


def decoded(content: Column) -> Column:
    """A text file's content as UTF-8, or as Latin-1 where it is none."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))
