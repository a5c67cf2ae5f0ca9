"""JSON exports as a Spark data source: ``spark.read.format("metaloom_records")``, batch and stream.

A partition is a file, so files are read in parallel where the tasks run. Rows are those of ``json_records.read_records``; what
the sources make of them (``orchestrator.parse_dags``) works on either. As a stream its offset is a mark in time, that of the latest
file read: an incremental sync reads the files changed since its mark, and the checkpoint keeps the mark.

Options: ``path`` (a folder, searched recursively, or a file), ``step`` (bytes scanned at once), ``since`` (first mark, in
nanoseconds; files changed later are read).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from metaloom.sources.json_records import MARK, STEP, scan

NAME = "metaloom_records"
SCHEMA = "location string, position long, value string, problem string"
_ARROW = pa.schema([("location", pa.string()), ("position", pa.int64()), ("value", pa.string()), ("problem", pa.string())])
ROWS = 1000


@dataclass
class FilePartition(InputPartition):
    location: str


def _listed(path: str) -> list[tuple[str, int]]:
    """(location, time of the last change in nanoseconds) of the files under a path; hidden ones and marks of writers are left out."""
    store, root = pafs.FileSystem.from_uri(path)
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    found = store.get_file_info(root)
    if found.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    files = [found] if found.is_file else store.get_file_info(pafs.FileSelector(root, recursive=True))
    kept = [f for f in files if f.is_file and not f.base_name.startswith(("_", "."))]
    return sorted((f"{scheme}{f.path}", f.mtime_ns or 0) for f in kept)


def _rows(location: str, step: int) -> Iterator[pa.RecordBatch]:
    store, path = pafs.FileSystem.from_uri(location)
    with store.open_input_stream(path, compression=None) as stream:
        data = np.frombuffer(stream.read(), np.uint8)
    skip = len(MARK) if data[: len(MARK)].tobytes() == MARK else 0
    objects, problems = scan(data[skip:], step)
    rows = [(location, skip + a, data[skip + a : skip + b].tobytes().decode("utf-8", "replace"), None) for a, b in objects] + [(location, skip + a, None, what) for a, what in problems]
    for i in range(0, len(rows), ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + ROWS], strict=True), _ARROW, strict=True)], schema=_ARROW)


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("step", STEP))

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(location) for location, _ in _listed(self.path)]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        yield from _rows(partition.location, self.step)


class RecordStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.step, self.since = options["path"], int(options.get("step", STEP)), int(options.get("since", 0))

    def initialOffset(self) -> dict:
        return {"mark": self.since}

    def latestOffset(self) -> dict:
        return {"mark": max([self.since, *(changed for _, changed in _listed(self.path))])}

    def partitions(self, start: dict, end: dict) -> list[FilePartition]:
        return [FilePartition(location) for location, changed in _listed(self.path) if start["mark"] < changed <= end["mark"]]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        yield from _rows(partition.location, self.step)

    def commit(self, end: dict) -> None:
        """Nothing to do: the checkpoint has the mark."""


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)

    def streamReader(self, schema) -> RecordStreamReader:  # noqa: N802
        return RecordStreamReader(self.options)


def register(spark: SparkSession) -> str:
    """Make the source known to the session; its name."""
    spark.dataSource.register(RecordSource)
    return NAME
