"""JSON objects of files, whatever their layout: one per line, many on a line, indented, in an array, with a byte order mark.

A record is a top-level object. Its borders come from brace depth outside of strings, so they don't depend on line breaks.
Files are scanned in parallel, each in steps of ``STEP`` bytes that hand on three numbers (depth, inside a string, pending
backslash). What isn't part of a record, and isn't a blank, a comma or a bracket, is reported, never skipped in silence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEP = 1 << 22
MARK = b"\xef\xbb\xbf"
_OPEN, _CLOSE, _QUOTE, _SLASH = (ord(x) for x in '{}"\\')
_between = np.zeros(256, bool)
_between[list(b" \t\r\n,[]")] = True


def scan(data: np.ndarray, step: int = STEP) -> tuple[list[tuple[int, int]], list[tuple[int, str]]]:
    """([begin, end) of each top-level object, (position, problem) of everything else) in the bytes of a file."""
    objects: list[tuple[int, int]] = []
    problems: list[tuple[int, str]] = []
    depth, inside, slash, begin, stray = 0, False, False, -1, False
    for low in range(0, len(data), step):
        part = data[low : low + step]
        at = np.arange(len(part), dtype=np.int32)
        # a quote counts unless an odd number of backslashes stands before it
        other = np.flatnonzero(part != _SLASH).astype(np.int32)
        last = np.full(len(part), -1, np.int32)
        last[other] = other
        last = np.maximum.accumulate(last)
        before = np.concatenate([[-1], last[:-1]])
        run = at - 1 - before + np.where(before < 0, int(slash), 0)
        quotes = (part == _QUOTE) & (run % 2 == 0)
        within = (np.cumsum(quotes) + int(inside)) % 2 == 1  # from an opening quote up to before its closing one
        plain = ~(within | quotes)
        turn = ((part == _OPEN) & plain).astype(np.int32) - ((part == _CLOSE) & plain)
        raw = depth + np.cumsum(turn)
        level = raw - np.minimum(np.minimum.accumulate(raw), 0)
        former = np.concatenate([[depth], level[:-1]])
        opens, closes = np.flatnonzero((turn == 1) & (level == 1)), np.flatnonzero((turn == -1) & (level == 0) & (former == 1))
        outside = (level == 0) & (former == 0) & ~_between[part]
        edges = np.flatnonzero(np.diff(np.concatenate([[int(stray)], outside.view(np.int8)])) == 1)
        problems += [(low + int(k), "text outside of objects") for k in edges]
        for k in sorted([*opens.tolist(), *closes.tolist()]):
            if part[k] == _OPEN:
                begin = low + k
            else:
                objects.append((begin, low + k + 1))
                begin = -1
        depth, inside, stray = int(level[-1]), bool(within[-1]), bool(outside[-1])
        tail = len(part) - 1 - int(last[-1])
        slash = (tail + (int(slash) if last[-1] < 0 else 0)) % 2 == 1
    if begin >= 0:
        problems.append((begin, "object without an end"))
    return objects, problems


def read_records(spark: SparkSession, path: str, step: int = STEP) -> DataFrame:
    """location, position (in bytes), value, problem: a row for each object of each file, and for each piece that is none (value null).

    A file is read as one value, so it may hold 2 GB. An empty file gives no rows.
    """

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for k, location in enumerate(frame.column(0).to_pylist()):
                content = frame.column(1)[k].as_buffer()
                data = np.frombuffer(content, np.uint8) if content is not None and content.size else np.zeros(0, np.uint8)
                skip = len(MARK) if data[: len(MARK)].tobytes() == MARK else 0
                objects, problems = scan(data[skip:], step)
                rows = [(location, skip + a, data[skip + a : skip + b].tobytes().decode("utf-8", "replace"), None) for a, b in objects]
                rows += [(location, skip + a, None, what) for a, what in problems]
                for i in range(0, len(rows), 1000):
                    columns = zip(*rows[i : i + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["location", "position", "value", "problem"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(batches, "location string, position long, value string, problem string")


def parse_records(records: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``schema`` with ``location`` and ``position``; problems: location, position, severity, message)."""
    kind = T._parse_datatype_string(schema)
    wide = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = records.withColumn("_row", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.col("problem").isNotNull() | F.col("_row._corrupt_record").isNotNull()
    rows = parsed.where(~broken).select("location", "position", *(F.col("_row")[f.name].alias(f.name) for f in kind.fields))
    problems = parsed.where(broken).select("location", "position", F.lit("error").alias("severity"), F.coalesce("problem", F.lit("not valid JSON")).alias("message"))
    return rows, problems
