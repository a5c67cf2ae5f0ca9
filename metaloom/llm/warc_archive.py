"""WARC archives of pages: written record by record, read back sequentially.

Writing: every task writes archives of its own into a folder all executors share. A record is one gzip member; an
archive begins with a ``warcinfo`` record and is closed when it is full. Of the pages with one payload (of at least
``least`` bytes) only that with the largest page_id carries it; the others are ``revisit`` records that name it. Names
of archives are new for every attempt of a task, and only the archives that successful attempts report are listed, so a
lost executor leaves nothing behind that is read.

Reading: an archive is a stream. Members are inflated in steps of ``CHUNK`` bytes, headers end at an empty line, the block
is as long as Content-Length says, and the digests of block and payload are computed while the bytes pass by: no record is
ever held whole. A damaged record becomes a row that says what is wrong, and reading goes on at the next member.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom import staging
from metaloom.llm.text import tidy
from metaloom.operators import joins

#: payloads of fewer bytes are always written
LEAST_BYTES = 1000
#: a new archive begins behind the record that fills this one, in compressed bytes
ARCHIVE_BYTES = 1 << 30
CHUNK = 1 << 16
#: headers of a record, in bytes
MOST_HEADERS = 1 << 20
#: payloads that occur more than once: up to so many are broadcast, more are joined by salted keys
BROADCAST_ROWS = 200_000
#: the date of all records, as "now" is never read
DATE = "2024-01-01T00:00:00Z"

# fixed values of the format
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:metaloom:page:"
MAGIC = b"\x1f\x8b\x08"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def _urn(page_id: str | None) -> str:
    return f"<{ID}{quote(page_id, safe='')}>" if page_id is not None else f"<{ID[:-1]}>"


def _page(urn: str | None) -> str | None:
    inner = (urn or "").strip("<>")
    return unquote(inner[len(ID) :]) if inner.startswith(ID) else None


def page_record(page_id: str | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """A response with its payload, or a revisit (``refers_to`` given) with the payload's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    named = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date)]
    if url:
        headers.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", named)]
    if refers_to is None:
        return member(headers, http + payload)
    return member([*headers, ("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)], http)


def decided(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html (null for revisits), size, digest, refers_to (null for responses) of every page.

    Payloads are equal when their SHA-256 is. Pages with the largest id of their payload, repeated rows included, are responses.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", body.alias("html")).select(
        "page_id", "url", "html", F.octet_length("html").cast("long").alias("size"), F.sha1("html").alias("digest"), F.sha2("html", 256).alias("key")
    )
    heads = rows.where(F.col("size") >= least).groupBy("key").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads, many = staging.stage_counted(heads, staging.new_stage(spark, "warc-heads"))
    if many <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(heads.select("key", "head")), "key", "left")
    else:
        hot = heads.where(F.col("n") > joins.HOT_ROWS).select(F.col("key").alias("_hot_key"), F.ceil(F.col("n") / joins.HOT_ROWS).cast("int").alias("_parts"))
        joined = joins.salt_rows(rows, "key", hot, "page_id").join(joins.fan_out(heads.select("key", "head"), "key", hot), ["key", "_salt"], "left")
    first = F.col("head").isNull() | F.col("page_id").eqNullSafe(F.col("head"))
    return joined.select(
        "page_id", "url", F.when(first, F.col("html")).alias("html"), "size", "digest", F.when(~first, F.col("head")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in ``folder``; their list: archive, records, n_bytes.

    A null html is an empty payload, a null url a record without one. Other columns are left out. An empty table has no archives.
    """
    spark = pages.sparkSession

    def write(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, records, size, closed = None, "", 0, 0, []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                closed.append((name, records, size))
                out = None

        context = TaskContext.get()
        for frame in frames:
            for page_id, url, html, n, digest, refers in zip(*(frame.column(k).to_pylist() for k in range(6)), strict=True):
                if out is None:
                    name = f"part-{context.partitionId():06d}-{len(closed):04d}-{uuid.uuid4().hex}.warc.gz"
                    out, records = store.open_output_stream(f"{root}/{name}", compression=None), 0
                    info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    out.write(info)
                    size = len(info)
                record = page_record(page_id, url, html or b"", n, digest, refers, date)
                out.write(record)
                records, size = records + 1, size + len(record)
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in closed], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "n_bytes"])

    rows = decided(pages, least).select(F.col("page_id").cast("string"), F.col("url").cast("string"), "html", "size", "digest", F.col("refers_to").cast("string"))
    written = rows.mapInArrow(tidy(write), "archive string, records long, n_bytes long")
    listed = staging.stage(written, staging.new_stage(spark, "warc-list"))
    return listed.withColumn("archive", F.concat(F.lit(folder.rstrip("/") + "/"), "archive"))


class Record(NamedTuple):
    """What was read of one record; ``problem`` is null for a sound one."""

    offset: int
    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int
    payload_sha1: str
    problem: str | None


class Damaged(ValueError):
    pass


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}


class Reader:
    """Records of one archive, given as a seekable binary stream, in order."""

    def __init__(self, stream, chunk: int = CHUNK):
        self.stream, self.chunk, self.at, self.ahead = stream, chunk, 0, b""

    def _inflated(self) -> Iterator[bytes]:
        """Bytes of the member that begins here, in steps of bounded size; the next one begins where it ends."""
        inflate = zlib.decompressobj(31)
        while not inflate.eof:
            self.ahead = self.ahead or self.stream.read(self.chunk)
            if not self.ahead:
                raise Damaged("the archive ends inside a record")
            given = self.ahead
            try:
                out = inflate.decompress(given, 4 * self.chunk)
            except zlib.error as error:
                raise Damaged("not a gzip member") from error
            self.ahead = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            self.at += len(given) - len(self.ahead)
            if out:
                yield out

    @staticmethod
    def _head(held: bytes, parts: Iterator[bytes]) -> tuple[bytes, bytes]:
        """Bytes up to the first empty line, and what was read beyond it."""
        while (end := held.find(b"\r\n\r\n")) < 0:
            if len(held) > MOST_HEADERS or not (more := next(parts, b"")):
                raise Damaged("headers without an end")
            held += more
        return held[:end], held[end + 4 :]

    def _one(self) -> Record:
        begin, parts = self.at, self._inflated()
        head, held = self._head(b"", parts)
        version, *lines = head.split(b"\r\n")
        headers = _fields(lines)
        if not version.startswith(b"WARC/1.") or not headers.get("content-length", "").isdigit():
            raise Damaged("no WARC record")
        left, block, payload, size, http = int(headers["content-length"]), hashlib.sha1(), hashlib.sha1(), 0, {}
        pending = b"" if headers.get("content-type", "").startswith("application/http") else None  # its own headers, until they end
        while left:
            if not held and not (held := next(parts, b"")):
                raise Damaged("the block is shorter than Content-Length")
            now, held = held[:left], held[left:]
            left -= len(now)
            block.update(now)
            if pending is not None:
                pending += now
                if (end := pending.find(b"\r\n\r\n")) < 0:
                    if len(pending) > MOST_HEADERS:
                        raise Damaged("headers without an end")
                    continue
                http, now, pending = _fields(pending[:end].split(b"\r\n")[1:]), pending[end + 4 :], None
            payload.update(now)
            size += len(now)
        for more in parts:
            held += more
            if len(held) > 4:
                break
        if held != b"\r\n\r\n":
            raise Damaged("the block is longer than Content-Length")
        wrong = None
        if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{base64.b32encode(block.digest()).decode()}":
            wrong = "the block doesn't have its digest"
        elif headers.get("warc-type") == "response" and headers.get("warc-payload-digest") != f"sha1:{base64.b32encode(payload.digest()).decode()}":
            wrong = "the payload doesn't have its digest"
        return Record(begin, headers, http, size, payload.hexdigest(), wrong)

    def _go_on(self, at: int) -> bool:
        """Move to the first member at or after ``at`` that holds a WARC record; false if there is none."""
        held = b""
        self.stream.seek(at)
        while more := self.stream.read(self.chunk):
            held += more
            k = held.find(MAGIC)
            while 0 <= k <= len(held) - 3:
                self.stream.seek(at + k)
                try:
                    begins = zlib.decompressobj(31).decompress(self.stream.read(4096), 7) == b"WARC/1."
                except zlib.error:
                    begins = False
                if begins:
                    self.stream.seek(at + k)
                    self.at, self.ahead = at + k, b""
                    return True
                k = held.find(MAGIC, k + 1)
            at, held = at + len(held) - 2, held[-2:]
            self.stream.seek(at + len(held))
        return False

    def __iter__(self) -> Iterator[Record]:
        while True:
            self.ahead = self.ahead or self.stream.read(self.chunk)
            if not self.ahead:
                return
            begin = self.at
            try:
                yield self._one()
            except Damaged as error:
                yield Record(begin, {}, {}, 0, "", str(error))
                if not self._go_on(begin + 1):
                    return


_READ = pa.schema(
    [("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("problem", pa.string())]
)


def _row(archive: str, x: Record) -> tuple:
    if not x.headers:
        return archive, x.offset, None, None, None, None, None, None, x.problem
    kind, size, problem = x.headers.get("warc-type"), x.payload_bytes, x.problem
    named = x.headers.get("warc-payload-digest", "")
    try:
        digest = base64.b32decode(named.removeprefix("sha1:")).hex() if kind == "revisit" else x.payload_sha1
        size = int(x.http["content-length"]) if kind == "revisit" else size  # of the full payload, which isn't here
    except (ValueError, KeyError):
        digest, problem = None, problem or "a revisit without digest or length of its payload"
    return archive, x.offset, _page(x.headers.get("warc-record-id")), x.headers.get("warc-target-uri"), size, digest, kind, _page(x.headers.get("warc-refers-to")), problem


def read_archives(archives: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Pages in the archives whose paths column ``archive`` lists, a row per response, revisit or damaged record.

    ``payload_bytes`` and ``payload_digest`` (hex SHA-1) are those of the full payload: computed from the bytes of responses, named by
    revisits. ``problem`` says what is wrong with a record, null for a sound one; a damaged one has nulls elsewhere but for archive and offset.
    """

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for archive in frame.column(0).to_pylist():
                store, path = pafs.FileSystem.from_uri(archive)
                with store.open_input_file(path) as stream:
                    rows = []
                    for x in Reader(stream, chunk):
                        if not x.headers or x.headers.get("warc-type") in ("response", "revisit"):
                            rows.append(_row(archive, x))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                    yield _batch(rows)

    spread = archives.select("archive").repartition(max(1, archives.count()))
    return spread.mapInArrow(tidy(read), "archive string, offset long, page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, problem string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(_READ)], schema=_READ)


def archive_pages(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Write all pages as archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset.

    A row per page, repeated rows and null ids included. Pages with an equal payload of ``least`` bytes or more: those with its largest
    page_id (a null id comes before all others) are responses, the rest revisit it. A record that is damaged when read back stops the query.
    """
    spark: SparkSession = pages.sparkSession
    kind = dict(pages.select("page_id").dtypes)["page_id"]
    read = read_archives(write_archives(pages, folder or staging.new_stage(spark, "warc"), least))
    sound = F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(" ", "archive", F.col("offset").cast("string"), "problem")))
    return read.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"), "archive", "offset")
