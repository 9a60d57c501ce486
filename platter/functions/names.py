"""File names: folding, hashing, cutting, short names, paths, protection masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_LOWER, ASCII_UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Latin-1 small letters that have a capital 32 below them.
LATIN_LOWER = "".join(chr(c) for c in range(0xE0, 0xFF) if c != 0xF7)
LATIN_UPPER = "".join(chr(ord(c) - 32) for c in LATIN_LOWER)

MAX_NAME, MAX_LONG_NAME = 30, 109


def fold(name: Column, international: bool = True) -> Column:
    """The case fold of names: a to z, and with `international` also the Latin-1 letters. ÿ, ß and ÷ stay."""
    lower, upper = (ASCII_LOWER + LATIN_LOWER, ASCII_UPPER + LATIN_UPPER) if international else (ASCII_LOWER, ASCII_UPPER)
    return F.translate(name, lower, upper)


def codes(name: Column) -> Column:
    """The code points of a name as an array."""
    return F.transform(F.filter(F.split(name, ""), lambda c: c != ""), lambda c: F.ascii(c))


def hash_slot(name: Column, slots: int = 72, international: bool = True) -> Column:
    """The slot of a name in a directory's hash table: from the length, times 13 plus each folded code, 11 bits."""
    if slots <= 0:
        return F.lit(0).cast("long")
    h = F.aggregate(codes(fold(name, international)), F.char_length(name).cast("long"), lambda h, c: (h * 13 + c).bitwiseAND(F.lit(0x7FF)))
    return h % slots


def same_name(a: Column, b: Column, international: bool = True) -> Column:
    """(F04)"""
    return fold(a, international) == fold(b, international)


def stored_name(name: Column, long_names: bool = False) -> Column:
    """The name as a volume keeps it."""
    return F.left(name, F.lit(MAX_LONG_NAME if long_names else MAX_NAME))


def components(path: Column) -> Column:
    """(F06)"""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def sanitized_path(path: Column) -> Column:
    """Archive paths: backslash and U+00FF separate too; empty parts, `.` and `..` go."""
    return F.array_join(F.filter(F.split(F.translate(path, "\\ÿ", "//"), "/"), lambda x: ~x.isin("", ".", "..")), "/")


def upper(name: Column) -> Column:
    """Capitals of ASCII and Latin-1; ß becomes two letters, ÿ its capital. Engines differ on other letters, which stay."""
    return F.translate(F.replace(name, F.lit("ß"), F.lit("SS")), ASCII_LOWER + LATIN_LOWER + "ÿ", ASCII_UPPER + LATIN_UPPER + "Ÿ")


#: What short names and labels cannot hold: all but capitals, digits and some marks; fixed sets.
NOT_SHORT = r"[^\p{Lu}\p{Lt}\p{Nd}!#$%&'()\-@^_`{}~]"
NOT_LABEL = r"[^\p{L}\p{M}\p{N}!#$%&'()\-@^_`{}~ ]"


def _short_part(part: Column, n: int) -> Column:
    return F.left(F.regexp_replace(upper(part), NOT_SHORT, ""), F.lit(n))


def short_base(name: Column) -> Column:
    """The part before the last dot, cut to 8 allowed characters; others go. A leading dot is no separator."""
    return _short_part(F.when(name.rlike(r"^.+\."), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name), 8)


def short_extension(name: Column) -> Column:
    return _short_part(F.when(name.rlike(r"^.+\."), F.regexp_extract(name, r"^.+\.([^.]*)$", 1)).otherwise(F.lit("")), 3)


def short_name(name: Column) -> Column:
    ext = short_extension(name)
    return F.when(ext == "", short_base(name)).otherwise(F.concat(short_base(name), F.lit("."), ext))


def short_checksum(name: Column) -> Column:
    """The checksum that ties long-name entries to the 11 bytes of a short name: rotate right, add."""
    raw = F.concat(F.rpad(short_base(name), 8, " "), F.rpad(short_extension(name), 3, " "))
    turn = lambda s: (s.bitwiseAND(F.lit(1)) * 128 + F.shiftright(s, 1)).cast("long")
    return F.aggregate(codes(raw), F.lit(0).cast("long"), lambda s, c: (turn(s) + c).bitwiseAND(F.lit(255)))


def volume_label(name: Column) -> Column:
    """(F16)"""
    return F.left(F.regexp_replace(upper(name), NOT_LABEL, ""), F.lit(11))


def iso_name(name: Column) -> Column:
    """Names of primary ISO directories: anything but printable ASCII becomes `_`, the version after the last `;` goes, and one dot
    at the end. (F17)"""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"[^\x20-\x7E]", "_"), r";[^;]*$", ""), r"\.$", "")


MASK = "hsparwed"


def protection_mask(bits: Column) -> Column:
    """hsparwed: h, s, p and a are on when set; r, w, e and d are on when clear."""
    parts = []
    for i, c in enumerate(MASK):
        on = bits.bitwiseAND(F.lit(1 << (7 - i)).cast("long")) != 0
        parts.append(F.when(on if i < 4 else ~on, F.lit(c)).otherwise(F.lit("-")))
    return F.concat(*parts)


def protection_bits(mask: Column) -> Column:
    """The inverse; null unless there are 8 characters, each its letter in either case or a dash."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(MASK):
        on = F.lower(F.substring(mask, i + 1, 1)) == c
        out = out + F.when(on if i < 4 else ~on, F.lit(1 << (7 - i)).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.when(F.lower(mask).rlike("^[h-][s-][p-][a-][r-][w-][e-][d-]$"), out)


def dos_type(value: Column) -> Column:
    """A disk type as text: three characters, a backslash and the last byte; unprintable ones are dots."""
    byte = lambda k: F.shiftright(value, 8 * k).bitwiseAND(F.lit(255).cast("long"))
    text = [F.when(byte(k).between(32, 126), F.chr(byte(k))).otherwise(F.lit(".")) for k in (3, 2, 1)]
    return F.concat(*text, F.lit("\\"), byte(0).cast("string"))
