"""Zip archives of CSV members as a Python data source.

``partitions`` reads each archive's central directory, which is at its end, and checks it; every CSV member is a partition
of its own.  A task opens its archive, seeks to its member and inflates it as a stream, ``CHUNK`` lines at a time, so its
memory follows a chunk and neither the member nor the archive.  Archives are opened through pyarrow's file systems, which
read local folders, HDFS and object stores by their addresses.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Most members and bytes (inflated) of an archive.
ZIP_MEMBERS, ZIP_BYTES = 64, 256 << 20
CHUNK = 20_000
SCHEMA = "path string, member string, row string"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") or ":/" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[str]:
    """The archives of a folder and the folders in it, or the one that the path names, in order."""
    store, inner = _opened(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    head = path.rstrip("/")
    return sorted(head + f.path[len(inner.rstrip("/")) :] for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))


def write_archive(path: str, members: dict[str, str]) -> None:
    """One zip archive of named texts."""
    store, inner = _opened(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    with store.open_output_stream(inner) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)


def csv_members(path: str) -> list[str]:
    """Names of an archive's CSV members; too many, too large ones and names that leave the archive are errors."""
    store, inner = _opened(path)
    with store.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
        infos = z.infolist()
    if len(infos) > ZIP_MEMBERS or sum(i.file_size for i in infos) > ZIP_BYTES:
        raise ValueError(f"{path}: too many or too large members")
    for i in infos:
        if i.filename.startswith("/") or ".." in i.filename.replace("\\", "/").split("/"):
            raise ValueError(f"{path}: unsafe member name {i.filename}")
    return [i.filename for i in infos if i.filename.lower().endswith(".csv")]


@dataclass
class Member(InputPartition):
    path: str
    name: str


class ZipCsvReader(DataSourceReader):
    def __init__(self, path: str, chunk: int) -> None:
        self.path, self.chunk = path, chunk

    def partitions(self) -> list[Member]:
        return [Member(path, name) for path in listed(self.path) for name in csv_members(path)] or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, inner = _opened(partition.path)
        with store.open_input_file(inner) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as body:
            try:
                chunks = pd.read_csv(body, dtype=str, chunksize=self.chunk, keep_default_na=False)
            except pd.errors.EmptyDataError:  # a blank member
                return
            for part in chunks:
                rows = [json.dumps(r) for r in part.to_dict("records")]
                if rows:
                    yield pa.RecordBatch.from_pydict({"path": [partition.path] * len(rows), "member": [partition.name] * len(rows), "row": rows})


class ZipCsvSource(DataSource):
    """Options: path (an archive, or a folder of them), chunk (lines held at once)."""

    @classmethod
    def name(cls) -> str:
        return "zip_csv"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipCsvReader:
        return ZipCsvReader(self.options["path"], int(self.options.get("chunk", CHUNK)))


def read_zip_csv(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Rows (path, member, row json): the lines of the CSV members of the archives below ``path``."""
    spark.dataSource.register(ZipCsvSource)
    return spark.read.format("zip_csv").option("chunk", chunk).load(path)
