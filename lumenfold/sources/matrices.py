"""NumPy matrices as a data source: reads by row ranges that the files' headers plan, writes in pieces of bounded size.

``format("matrix")`` gives (file, row, values). A task reads one range of one file, in batches of
``batch_bytes``; a file of any size is split. Object arrays are refused, and so are more than two
axes; a vector is one row. On the way out a task keeps at most one piece of rows (``piece_bytes``),
names it for its attempt, and the pieces get their final names on commit, so an attempt that is
lost or repeated leaves nothing behind.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file string, row long, values array<double>"
#: Bytes of a planned range, of a batch in a task, and of a written piece.
RANGE_BYTES, BATCH_BYTES, PIECE_BYTES = 32 << 20, 4 << 20, 16 << 20
#: The most that a header may take; those of plain numeric arrays have some hundred bytes.
HEADER_BYTES = 1 << 16


@dataclass(frozen=True)
class Header:
    """What a file's header says: rows, width, whether columns are stored one after another, element type, and where the numbers begin."""

    rows: int
    width: int
    by_column: bool
    dtype: str
    start: int


@dataclass
class RowRange(InputPartition):
    file: str
    header: Header
    first: int
    upto: int


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def matrix_files(path: str) -> list[str]:
    """The matrix files of a folder, hidden ones left out, or the file itself."""
    system, at = located(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [at]
    found = system.get_file_info(fs.FileSelector(at))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".npy") and f.base_name[0] not in "._")


def read_header(system: fs.FileSystem, file: str) -> Header:
    with system.open_input_file(file) as f:
        head = io.BytesIO(f.read(HEADER_BYTES))
    version = np.lib.format.read_magic(head)
    shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if dtype.hasobject or dtype.kind not in "biuf":
        raise ValueError(f"{file} holds {dtype}, not numbers")
    if len(shape) > 2:
        raise ValueError(f"{file} has {len(shape)} axes")
    rows, width = shape if len(shape) == 2 else (1, *(shape or (1,)))
    return Header(rows, width, by_column and len(shape) == 2, dtype.str, head.tell())


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, batch_bytes: int) -> None:
        self.path, self.range_bytes, self.batch_bytes = path, range_bytes, batch_bytes

    def partitions(self) -> list[RowRange]:
        system, _ = located(self.path)
        out = []
        for file in matrix_files(self.path):
            h = read_header(system, file)
            step = max(1, self.range_bytes // max(1, h.width * np.dtype(h.dtype).itemsize))
            out += [RowRange(file, h, at, min(h.rows, at + step)) for at in range(0, h.rows, step)]
        return out

    def read(self, partition: RowRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file, or files without rows
            return
        system, _ = located(self.path)
        h = partition.header
        step = max(1, self.batch_bytes // max(1, h.width * 8))
        with system.open_input_file(partition.file) as f:
            for first in range(partition.first, partition.upto, step):
                upto = min(partition.upto, first + step)
                values = read_rows(f, h, first, upto).astype(np.float64, copy=False).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(upto - first + 1, dtype=np.int32) * h.width), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * (upto - first)), pa.array(np.arange(first, upto)), lists], names=["file", "row", "values"])


def read_rows(f: pa.NativeFile, h: Header, first: int, upto: int) -> np.ndarray:
    """Rows of an open file; of one stored by columns, a stretch of each column."""
    dtype = np.dtype(h.dtype)

    def stretch(at: int, n: int) -> np.ndarray:
        f.seek(h.start + at * dtype.itemsize)
        found = f.read(n * dtype.itemsize)
        if len(found) < n * dtype.itemsize:
            raise ValueError(f"a matrix of {h.rows} rows ends before row {upto}")
        return np.frombuffer(found, dtype)

    if not h.by_column:
        return stretch(first * h.width, (upto - first) * h.width).reshape(upto - first, h.width)
    return np.stack([stretch(c * h.rows + first, upto - first) for c in range(h.width)], axis=1) if h.width else np.empty((upto - first, 0), dtype)


@dataclass
class Pieces(WriterCommitMessage):
    """What a task has written: (temporary name, final name) pairs."""

    names: list[tuple[str, str]]


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, piece_bytes: int) -> None:
        vectors = [f.name for f in schema if f.dataType.typeName() == "array"]
        if len(vectors) != 1:
            raise ValueError(f"one array column is written, not {vectors}")
        self.path, self.column, self.overwrite, self.piece_bytes = path, vectors[0], overwrite, piece_bytes
        system, at = located(path)
        self.folder, self.run = at.rstrip("/"), uuid.uuid4().hex
        if system.get_file_info(at).type != fs.FileType.NotFound and not overwrite and matrix_files(path):
            raise FileExistsError(path)
        system.create_dir(f"{self.folder}/_temporary-{self.run}", recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Pieces:
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system, _ = located(self.path)
        names: list[tuple[str, str]] = []
        held: list[np.ndarray] = []
        rows = width = 0

        def flush() -> None:
            nonlocal rows
            if rows:
                final = f"part-{task:05d}-{len(names):05d}-{self.run[:12]}.npy"
                name = f"{self.folder}/_temporary-{self.run}/{attempt}-{final}"
                with system.open_output_stream(name) as f:
                    np.save(f, np.concatenate(held), allow_pickle=False)
                names.append((name, final))
                held.clear()
                rows = 0

        for batch in batches:
            column = batch.column(self.column)
            sizes = np.unique(np.diff(column.offsets.to_numpy())) if len(column) else np.array([], int)
            if column.null_count or column.flatten().null_count:
                raise ValueError("a matrix holds no nulls")
            if len(sizes) > 1 or (width and len(sizes) and sizes[0] != width):
                raise ValueError(f"rows of {sorted({*map(int, sizes), *([width] if width else [])})} numbers in one matrix")
            if len(sizes):
                width = int(sizes[0])
                m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), width)
                step = max(1, self.piece_bytes // max(1, 8 * width))
                at = 0
                while at < len(m):
                    take = min(step - rows, len(m) - at)
                    held.append(m[at : at + take])
                    at, rows = at + take, rows + take
                    if rows == step:
                        flush()
        flush()
        return Pieces(names)

    def commit(self, messages: list[Pieces | None]) -> None:
        system, _ = located(self.path)
        old = matrix_files(self.path) if self.overwrite else []
        for m in messages:
            for name, final in m.names if m else []:
                system.move(name, f"{self.folder}/{final}")
        for file in old:
            system.delete_file(file)
        system.delete_dir(f"{self.folder}/_temporary-{self.run}")

    def abort(self, messages: list[Pieces | None]) -> None:
        system, _ = located(self.path)
        system.delete_dir(f"{self.folder}/_temporary-{self.run}")


class MatrixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return SCHEMA

    def _bytes(self, option: str, default: int) -> int:
        return int(self.options.get(option, default))

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(self.options["path"], self._bytes("range_bytes", RANGE_BYTES), self._bytes("batch_bytes", BATCH_BYTES))

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options["path"], schema, overwrite, self._bytes("piece_bytes", PIECE_BYTES))
