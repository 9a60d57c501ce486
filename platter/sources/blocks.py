"""Raw images as a table of blocks, read by ranges, so that one large image is many tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan
from pyspark.sql.types import StructType


class Range(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        super().__init__(first)
        self.path, self.first, self.end = path, first, end


class BlockSource(DataSource):
    """spark.dataSource.register(BlockSource); spark.read.format("diskblocks").option("path", p).load()

    Options: path (one or more, separated by commas; any that pyarrow opens), block_size (512), blocks_per_task (65536). A last
    part shorter than a block is a block of its own. pushdown (false): filters on lba prune ranges, which needs
    spark.sql.python.filterPushdown.enabled; Spark applies them again, so results do not depend on it."""

    @classmethod
    def name(cls) -> str:
        return "diskblocks"

    def schema(self) -> str:
        return "image string, lba bigint, data binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushingBlockReader if self.options.get("pushdown", "false").lower() == "true" else BlockReader)(self.options)


class BlockReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p.strip() for p in options["path"].split(",")]
        self.size, self.per = int(options.get("block_size", 512)), int(options.get("blocks_per_task", 65_536))
        self.low, self.high = 0, None

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for p in self.paths:
            store, path = fs.FileSystem.from_uri(p)
            n = -(-store.get_file_info(path).size // self.size)
            end = n if self.high is None else min(n, self.high)
            out += [Range(p, k, min(k + self.per, end)) for k in range(self.low, end, self.per)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:  # type: ignore[override]
        store, path = fs.FileSystem.from_uri(partition.path)
        with store.open_input_file(path) as f:
            for first in range(partition.first, partition.end, 2048):
                end = min(first + 2048, partition.end)
                raw = f.read_at((end - first) * self.size, first * self.size)
                data = [raw[i : i + self.size] for i in range(0, len(raw), self.size)]
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(data)), pa.array(range(first, first + len(data)), pa.int64()), pa.array(data, pa.binary())], ["image", "lba", "data"])


class PushingBlockReader(BlockReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("lba",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, EqualTo):
                    self.low, self.high = max(self.low, f.value), f.value + 1
                elif isinstance(f, GreaterThanOrEqual):
                    self.low = max(self.low, f.value)
                elif isinstance(f, LessThan):
                    self.high = f.value if self.high is None else min(self.high, f.value)
            yield f  # Spark checks all of them again
