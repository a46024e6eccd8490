"""Matrices in ``.npz`` files (array ``arr``, a row for each row) as a data source: ``spark.read.format("npz")``.

Files are read in ranges of rows, each a partition: a range is streamed out of the archive up to its
last row, and no task holds more than BATCH rows. Writing makes one file a task, with the rows' ids beside them
in ``ids``; a file without ids numbers its rows, with its own name telling files apart.
Paths are any that Arrow's file systems know (local, HDFS, object stores).
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "file string, row long, values array<float>"
#: Rows of a partition, and of a batch.
RANGE, BATCH = 100_000, 2048


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _member(archive: zipfile.ZipFile, name: str):
    """(stream behind the header, shape, kind) of an array in C order."""
    held = archive.open(f"{name}.npy")
    version = np.lib.format.read_magic(held)
    shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(held)
    if fortran or kind.hasobject:
        raise ValueError(f"{name} is no plain array in row order")
    return held, shape, kind


def _skip(held, n: int) -> None:
    while n > 0:
        n -= len(got := held.read(min(n, 1 << 20)))
        if not got:
            raise EOFError("the array ends before its last row")


@dataclass
class Range(InputPartition):
    path: str
    low: int
    high: int


@dataclass
class Written(WriterCommitMessage):
    path: str


class NpzReader(DataSourceReader):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[Range]:
        system, path = _system(self.path)
        about = system.get_file_info(path)
        found = [about] if about.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
        if about.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        out = []
        for one in sorted(x.path for x in found if x.path.endswith(".npz")):
            with system.open_input_file(one) as file, zipfile.ZipFile(file) as archive:
                n = _member(archive, "arr")[1][0]
            out += [Range(one, low, min(low + self.rows, n)) for low in range(0, max(n, 1), self.rows)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        system, _ = _system(self.path)
        name = posixpath.basename(partition.path)
        with system.open_input_file(partition.path) as file, zipfile.ZipFile(file) as archive:
            held, shape, kind = _member(archive, "arr")
            width = int(np.prod(shape[1:]))
            _skip(held, partition.low * width * kind.itemsize)
            ids = None
            if "ids.npy" in archive.namelist():
                ids, _, id_kind = _member(archive, "ids")
                _skip(ids, partition.low * id_kind.itemsize)
            for low in range(partition.low, partition.high, BATCH):
                n = min(BATCH, partition.high - low)
                values = np.frombuffer(held.read(n * width * kind.itemsize), kind).astype(np.float32)
                rows = np.frombuffer(ids.read(n * id_kind.itemsize), id_kind).astype(np.int64) if ids else np.arange(low, low + n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values, pa.float32()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(rows, pa.int64()), lists], ["file", "row", "values"])


class NpzWriter(DataSourceArrowWriter):
    """A file is written under a hidden name, and gets its own when the whole write ends well. Rows of a file have one length."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex
        system, where = _system(path)
        system.create_dir(where, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, where = _system(self.path)
        context = TaskContext.get()
        name = f"{where}/_{self.run}-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex[:8]}.npz"
        parts, ids = [], []
        for batch in iterator:
            if batch.num_rows:
                lists = batch.column(batch.schema.get_field_index("values"))
                sizes = np.diff(np.asarray(lists.offsets))
                if lists.null_count or (sizes != sizes[0]).any() or (parts and parts[0].shape[1] != sizes[0]):
                    raise ValueError("rows of a matrix have one length")
                parts.append(np.asarray(lists.flatten(), np.float32).reshape(batch.num_rows, -1))
                ids.append(np.asarray(batch.column(batch.schema.get_field_index("row")), np.int64))
        if not parts:
            return Written("")
        held = io.BytesIO()
        np.savez_compressed(held, arr=np.concatenate(parts), ids=np.concatenate(ids))
        with system.open_output_stream(name) as out:
            out.write(held.getvalue())
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        system, where = _system(self.path)
        mine = [m.path for m in messages if m and m.path]
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(where)):
                if old.path.endswith(".npz") and old.path not in mine and not posixpath.basename(old.path).startswith("_"):
                    system.delete_file(old.path)
        for k, path in enumerate(mine):
            system.move(path, f"{where}/part-{k:05d}-{self.run[:8]}.npz")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.path)
        for m in messages:
            if m and m.path:
                system.delete_file(m.path)


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options["path"], int(self.options.get("rows", RANGE)))

    def writer(self, schema, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options["path"], overwrite)


def read_matrix(spark: SparkSession, path: str, rows: int = RANGE) -> DataFrame:
    """(file, row, values) of a file or of the files of a folder."""
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz").option("rows", rows).load(path)


def write_matrix(df: DataFrame, path: str, row: str, values: str, mode: str = "overwrite") -> None:
    """One file a task: the rows' ids and vectors, whose partitions must fit in a task's memory as a matrix does."""
    df.sparkSession.dataSource.register(NpzSource)
    df.selectExpr("cast(null as string) as file", f"cast(`{row}` as bigint) as row", f"cast(`{values}` as array<float>) as `values`").write.format("npz").mode(mode).save(path)
