"""Arrays in .npy files by ranges of rows: a data source whose tasks each read their part of a file."""

from __future__ import annotations

import ast
import math
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES = 64 << 20  # of a file that one task reads
BATCH_BYTES = 4 << 20
SCHEMA = "name string, row long, vector array<double>"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path on it of a URI or a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def header(files: fs.FileSystem, path: str) -> tuple[np.dtype, tuple[int, ...], bool, int]:
    """(type, shape, by columns, first byte) from the head of a .npy file; the array isn't read."""
    with files.open_input_file(path) as f:
        magic = f.read(8)
        if magic[:6] != b"\x93NUMPY":
            raise ValueError(f"not a .npy file: {path}")
        size = struct.unpack("<H", f.read(2))[0] if magic[6] == 1 else struct.unpack("<I", f.read(4))[0]
        fields = ast.literal_eval(f.read(size).decode("latin1" if magic[6] < 3 else "utf-8"))
        kind = np.dtype(fields["descr"])
        if kind.kind not in "biuf":
            raise ValueError(f"not an array of numbers: {path}")
        return kind, tuple(fields["shape"]), bool(fields["fortran_order"]), f.tell()


class Stretch(InputPartition):
    """Rows [start, stop) of one file."""

    def __init__(self, path: str, start: int, stop: int):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


class NpyReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def files(self) -> list[str]:
        """The file, or the .npy files of the folder, in order."""
        files, path = opened(self.path)
        info = files.get_file_info(path)
        if info.type == fs.FileType.Directory:
            return sorted(x.path for x in files.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(".npy"))
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        return [path]

    def partitions(self) -> list[Stretch]:
        """Only headers are read here: stretches of about part_bytes each."""
        files, _ = opened(self.path)
        out = []
        for path in self.files():
            kind, shape, _, _ = header(files, path)
            rows, width = _extent(shape)
            step = max(1, self.part_bytes // max(1, width * kind.itemsize))
            out += [Stretch(path, a, min(rows, a + step)) for a in range(0, rows, step)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        kind, shape, by_columns, first = header(files, partition.path)
        rows, width = _extent(shape)
        name = os.path.basename(partition.path).removesuffix(".npy")
        step = max(1, BATCH_BYTES // max(1, width * kind.itemsize))
        with files.open_input_file(partition.path) as f:
            for a in range(partition.start, partition.stop, step):
                b = min(partition.stop, a + step)
                if by_columns and width > 1:
                    part = np.stack([np.frombuffer(f.read_at((b - a) * kind.itemsize, first + (c * rows + a) * kind.itemsize), kind) for c in range(width)], axis=1)
                else:
                    part = np.frombuffer(f.read_at((b - a) * width * kind.itemsize, first + a * width * kind.itemsize), kind).reshape(b - a, width)
                flat = pa.array(np.ascontiguousarray(part, dtype=np.float64).reshape(-1))
                ends = pa.array(np.arange(b - a + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays([pa.array([name] * (b - a)), pa.array(np.arange(a, b)), pa.ListArray.from_arrays(ends, flat)], ["name", "row", "vector"])


def _extent(shape: tuple[int, ...]) -> tuple[int, int]:
    """(rows, numbers of a row); an array of one axis is one row, as read_arrays() has it."""
    return (shape[0], math.prod(shape[1:])) if len(shape) > 1 else (1, shape[0] if shape else 1)


class NpySource(DataSource):
    """Format `npy`: option path (a file or a folder, local or a URI that pyarrow opens), partBytes."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("partbytes", PART_BYTES)))


def read_npy(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(name, row, vector) of a .npy file or a folder of them; a file of any size is dealt over tasks by its rows.

    Arrays of one axis are one row; those of more have the first axis as rows and the rest in one vector, by rows or by
    columns as the file has them. A file that is no array of numbers is an error.
    """
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("partBytes", part_bytes).load(path)


def write_npy(df: DataFrame, path: str, order: str, vector: str, dim: int) -> int:
    """Writes a vector column in the order of a column as files part-<k>.npy of a folder, each by the task that holds its rows; gives their number.

    Vectors that are null or of another length are rows of NaN. A task that runs again writes the same file anew.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [np.array([r if r is not None and len(r) == dim else [np.nan] * dim for r in batch.column(0).to_pylist()], dtype=np.float64).reshape(-1, dim) for batch in batches]
        x = np.concatenate(parts) if parts else np.zeros((0, dim))
        if len(x):
            files, folder = opened(path)
            files.create_dir(folder, recursive=True)
            target = f"{folder}/part-{TaskContext.get().partitionId():05d}.npy"
            attempt = f"{target}.{TaskContext.get().taskAttemptId()}"
            with files.open_output_stream(attempt) as f:
                np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": x.shape})
                f.write(x.tobytes())
            files.move(attempt, target)
        yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64())], ["n"])

    ordered = df.orderBy(order).select(vector)
    return ordered.mapInArrow(save, "n long").groupBy().sum("n").first()[0] or 0
