"""Dense array files (``.npy``) as tables of ``position, embedding``, read and written by all tasks.

A file, or a folder of files in the order of their names, is read as a Spark data source: the headers give
the number of rows of every file, row ranges become partitions, and each task reads its own bytes. Rows
are numbered over all files, so vectors can stand beside rows by position.

Only two-dimensional C-ordered files of little-endian 4- or 8-byte floats are read; any other header, files of
different width and files that end early are refused. Paths are those that Arrow's file systems reach from
executors: shared folders and object stores.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 * 1024 * 1024  # of a partition
BATCH_ROWS = 4096
FILE_ROWS = 65_536  # of a file that is written
SCHEMA = "position bigint, embedding array<double>"


def _place(path: str):
    """File system and path; ``file:/a`` is a local path as well."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    store, place = _place(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        return [place]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(place))
    return sorted(f.path for f in found if f.path.endswith(".npy"))


@dataclass(frozen=True)
class Header:
    rows: int
    width: int
    kind: str
    offset: int


def header_of(path: str, name: str) -> Header:
    """What a file holds; anything but rows of floats in C order is refused."""
    from numpy.lib import format as npy

    store, _ = _place(path)
    with store.open_input_file(name) as file:
        version = npy.read_magic(file)
        read = npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0
        shape, columns_first, kind = read(file)
        if columns_first or len(shape) != 2 or kind.str not in ("<f4", "<f8"):
            raise ValueError(f"{name}: rows of floats in C order are read, not {kind.str} of shape {shape}")
        found = Header(shape[0], shape[1], kind.str, file.tell())
        if file.size() < found.offset + found.rows * found.width * kind.itemsize:
            raise ValueError(f"{name} ends before its last row")
    return found


@dataclass
class Rows(InputPartition):
    name: str
    header: Header
    first: int  # row of the file
    last: int
    before: int  # rows of the files before


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        out, before, widths = [], 0, set()
        for name in _files(self.path):
            header = header_of(self.path, name)
            widths.add(header.width)
            step = max(1, self.bytes // max(1, header.width * np.dtype(header.kind).itemsize))
            for first in range(0, header.rows, step):
                out.append(Rows(name, header, first, min(first + step, header.rows), before))
            before += header.rows
        if len(widths) > 1:
            raise ValueError(f"vectors of different lengths: {sorted(widths)}")
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        store, _ = _place(self.path)
        header, kind = partition.header, np.dtype(partition.header.kind)
        width = header.width * kind.itemsize
        target = pa.list_(pa.float64())
        with store.open_input_file(partition.name) as file:
            file.seek(header.offset + partition.first * width)
            for first in range(partition.first, partition.last, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.last - first)
                values = np.frombuffer(file.read(n * width), kind).astype("float64")
                offsets = pa.array(np.arange(n + 1, dtype="int32") * header.width)
                vectors = pa.ListArray.from_arrays(offsets, pa.array(values)).cast(target)
                places = pa.array(np.arange(first, first + n) + partition.before)
                yield pa.RecordBatch.from_arrays([places, vectors], names=["position", "embedding"])


class ArrayFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options)


def read_arrays(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``position, embedding`` of all rows of a file or folder."""
    spark.dataSource.register(ArrayFiles)
    return spark.read.format("array_files").option("rangeBytes", str(range_bytes)).load(path)


def write_arrays(vectors: DataFrame, key: str, vec: str, path: str, file_rows: int = FILE_ROWS) -> int:
    """Write vectors in the order of their keys, as files of at most ``file_rows`` rows; their number.

    A file is written by one task from rows it holds, and named by the task's place in that order, so a
    task that runs again writes the same names.
    """
    ordered = vectors.select(key, F.col(vec).cast("array<double>").alias("v")).repartitionByRange(key)
    ordered = ordered.sortWithinPartitions(key).select(F.spark_partition_id().alias("part"), "v")
    store, place = _place(path)
    store.create_dir(place, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from numpy.lib import format as npy

        store, place = _place(path)
        held, number, part, rows = [], 0, None, 0

        def write() -> None:
            name = f"{place}/{part:08d}-{number:06d}.npy"
            # seen under its name only when it is whole
            draft = f"{place}/.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as file:
                npy.write_array(file, np.concatenate(held).astype("<f8"), (1, 0))
            store.move(draft, name)

        for batch in batches:
            for start in range(0, batch.num_rows, file_rows):
                piece = batch.slice(start, file_rows)
                part = piece.column(0)[0].as_py()
                flat = piece.column(1).flatten().to_numpy(zero_copy_only=False)
                matrix = flat.reshape(piece.num_rows, -1)
                room = file_rows - sum(map(len, held))
                held.append(matrix[:room])
                rows += len(matrix)
                if room <= len(matrix):
                    write()
                    held, number = [matrix[room:]], number + 1
        if sum(map(len, held)):
            write()
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["n"])

    return ordered.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
