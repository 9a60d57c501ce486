"""Geometry of disks and volumes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADS, SECTORS, BLOCK = 16, 63, 512
LOW_CYLINDER = 2
#: Limits in MB and sectors per cluster that FAT32 volumes use up to them; fixed values.
CLUSTERS = ((512, 1), (8192, 8), (16384, 16), (32768, 32))
LARGEST_CLUSTER = 64


def of_size(size: Column) -> list[Column]:
    """Cylinders (cut to whole ones) and what follows from them."""
    per = HEADS * SECTORS
    cyl = F.floor(size / (per * BLOCK)).cast("long")
    lit = lambda x: F.lit(x).cast("long")
    return [cyl.alias("cylinders"), (cyl * per).alias("blocks"), lit(LOW_CYLINDER).alias("low_cyl"), (cyl - 1).alias("high_cyl"), lit(LOW_CYLINDER * per - 1).alias("rdb_block_hi"), lit(LOW_CYLINDER * per * BLOCK).alias("first_byte"), (cyl * per * BLOCK - 1).alias("last_byte")]


def fat_layout(sectors: Column, reserved: int = 32, fats: int = 2) -> list[Column]:
    """Cluster and table sizes of a FAT32 volume."""
    mb = F.floor(sectors / 2048)
    spc = F.lit(LARGEST_CLUSTER)
    for limit, n in reversed(CLUSTERS):
        spc = F.when(mb <= limit, F.lit(n)).otherwise(spc)
    spc = spc.cast("long")
    fat = (F.floor((sectors - reserved) * 4 / (spc * BLOCK + 4 * fats)) + 1).cast("long")
    data = fat * fats + reserved
    return [sectors.alias("sectors"), spc.alias("sectors_per_cluster"), fat.alias("fat_sectors"), data.alias("data_sector"), F.floor((sectors - data) / spc).cast("long").alias("clusters")]


#: Spans of 1,024-byte blocks and how many of them need one reserved block, in order; fixed values.
RESERVED_SPANS = ((20480, 20), (51200, 30), (512000, 40), (1048567, 50), (10_000_000, 70))
RESERVED_REST, RESERVED_MOST = 80, 4096 + 255 * 1024 * 8


def reserved_blocks(sectors: Column, most: int | None = RESERVED_MOST) -> Column:
    """How many reserved blocks a PFS3 volume of so many sectors has; most=None: by size alone, also where no volume has so many."""
    left, taken = F.floor(sectors / 2).cast("long"), F.lit(10).cast("long")
    for span, each in RESERVED_SPANS:
        part = F.least(F.greatest(left, F.lit(0)), F.lit(span))
        taken = taken + F.floor(part / each).cast("long")
        left = left - span
    taken = taken + F.floor(F.greatest(left, F.lit(0)) / RESERVED_REST).cast("long")
    taken = taken if most is None else F.least(taken, F.lit(most))
    return (F.floor((taken + 31) / 32) * 32).cast("long")


def volume_id(ts: Column) -> Column:
    """A serial number from a time: day and month with hundredths and seconds below, minute, hour and year above."""
    hundredths = F.floor((F.unix_micros(ts) % 1_000_000) / 10_000)
    low = F.dayofmonth(ts) + F.month(ts) * 256 + hundredths + F.second(ts) * 256
    high = F.minute(ts) + F.hour(ts) * 256 + F.year(ts)
    return low.cast("long").bitwiseOR(F.shiftleft(high.cast("long"), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def packed_division(value: Column, by: Column) -> Column:
    """Remainder in the upper and quotient in the lower 16 bits; the value itself if the quotient needs more."""
    quotient = F.floor(value / by).cast("long")
    return F.when(quotient > 0xFFFF, value).otherwise(F.shiftleft(value % by, 16).bitwiseOR(quotient)).cast("long")
