"""Contents written out as a tree of files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SIDECAR = ".uaem"


def to_folder(contents: DataFrame, folder: str) -> DataFrame:
    """Writes each content of contents (path, content and, if there is one, sidecar) to its path below a folder that all executors
    see, and gives path and size. Parts of paths that lead elsewhere go; a null content is an empty file; a sidecar that is not
    null lies beside its file. A file appears whole, under its name, by a move, so a task that runs again or twice does no harm.
    Lazy: the files are written when the result is."""
    columns = [c for c in ("path", "content", "sidecar") if c in contents.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)

        def put(path: str, raw: bytes) -> None:
            at, _, _ = f"{root}/{path}".rpartition("/")
            store.create_dir(at, recursive=True)
            with store.open_output_stream(made := f"{at}/.{uuid.uuid4().hex}") as out:
                out.write(raw)
            store.move(made, f"{root}/{path}")

        for b in batches:
            sizes, paths = [], []
            for row in b.to_pylist():
                path = "/".join(p for p in (row["path"] or "").split("/") if p not in ("", ".", ".."))
                if path:
                    put(path, row["content"] or b"")
                    if row.get("sidecar") is not None:
                        put(path + SIDECAR, row["sidecar"].encode())
                    paths.append(path)
                    sizes.append(len(row["content"] or b""))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    return contents.select(columns).mapInArrow(run, "path string, size bigint")


#: Bytes of files that are read before their rows go on.
READ_TOGETHER = 4 << 20


def from_folder(paths: DataFrame, folder: str) -> DataFrame:
    """path and content of the files that to_folder wrote, by the paths it gave: nothing is listed, so names that a listing hides or
    reads as escapes are there too, and a file that is missing is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            names: list[str] = []
            contents: list[bytes] = []
            held = 0
            for path in b["path"].to_pylist():
                with store.open_input_stream(f"{root}/{path}") as file:
                    contents.append(file.read())
                names.append(path)
                held += len(contents[-1])
                if held >= READ_TOGETHER:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                    names, contents, held = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    return paths.select("path").mapInArrow(run, "path string, content binary")
