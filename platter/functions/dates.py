"""Time stamps of the formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1970 to 1978, where day 0 is.
EPOCH = 252_460_800
DAY, TICK = 86_400, 50


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def datestamp(ts: Column, rounded: bool = True) -> tuple[Column, Column, Column]:
    """(day, minute, tick) of a time, at least the epoch; to the nearest 1/50 s, or cut to whole seconds."""
    us = F.greatest(micros(ts) - EPOCH * 1_000_000, F.lit(0).cast("long"))
    ticks = F.floor((us + 10_000) / 20_000) if rounded else F.floor(us / 1_000_000) * TICK
    ticks = ticks.cast("long")
    return F.floor(ticks / (DAY * TICK)).cast("long"), F.floor(ticks / (60 * TICK)).cast("long") % 1440, ticks % (60 * TICK)


def from_datestamp(day: Column, minute: Column, tick: Column) -> Column:
    """(F41)"""
    return F.timestamp_micros((day * DAY + minute * 60 + EPOCH) * 1_000_000 + tick * 20_000)


def fat_date(ts: Column) -> Column:
    """(F43)"""
    return F.shiftleft(F.year(ts) - 1980, 9).bitwiseOR(F.shiftleft(F.month(ts), 5)).bitwiseOR(F.dayofmonth(ts)).cast("long")


def fat_time(ts: Column) -> Column:
    return F.shiftleft(F.hour(ts), 11).bitwiseOR(F.shiftleft(F.minute(ts), 5)).bitwiseOR(F.floor(F.second(ts) / 2).cast("int")).cast("long")


def dos_timestamp(ts: Column) -> Column:
    """Date and time in 32 bits, the year held between 1980 and 2107."""
    year = F.least(F.greatest(F.year(ts), F.lit(1980)), F.lit(2107)) - 1980
    date = F.shiftleft(year, 9).bitwiseOR(F.shiftleft(F.month(ts), 5)).bitwiseOR(F.dayofmonth(ts)).cast("long")
    return F.shiftleft(date, 16).bitwiseOR(fat_time(ts))
