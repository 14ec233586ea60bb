"""WARC archives kept as tables of record chunks.

An archive is the byte stream of its records; a row holds one piece of it, named
by record and chunk number, so a payload of any size passes through tasks in
small pieces. Each payload piece carries the SHA-1 of the payload up to its
end, which the reader checks as it goes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import Workspace

CHUNK_BYTES = 64 * 1024
_END = b"\r\n\r\n"
CHUNKS = "archive int, record string, chunk long, data binary, sha1_so_far string"
PAGES = (
    "page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_head(
    record: str, page_id: int | None, url: str | None, size: int, digest: str, first: int | None,
    revisit: bool, date: str,
) -> bytes:
    """WARC and HTTP headers of a page; a revisit stops after them."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
        f"Content-Length: {size}\r\n\r\n"
    )
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{record}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else size)}",
    ]
    if url is not None:
        # A target holds no control characters, blanks or characters beyond ASCII; a
        # url that does is given whole as well, so that it comes back as it was.
        target = quote(url, safe=_SAFE)
        lines.append(f"WARC-Target-URI: {target}")
        if target != url or not url:
            lines.append(f"Page-URL: {quote(url, safe='')}")
    if page_id is not None:
        lines.append(f"Page-Number: {page_id}")
    if revisit:
        lines.append(
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        )
        lines.append(f"Page-Number-Referred: {first}")
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%") + "%"


def write_archives(
    pages: DataFrame,
    least_revisit_bytes: int = 0,
    chunk_bytes: int = CHUNK_BYTES,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Chunk rows of all records (`CHUNKS`), one record per page row.

    Of pages with equal payloads of at least `least_revisit_bytes`, those with the
    smallest `page_id` are responses and the others revisits of it. Equality is
    length and SHA-1. Grouping sees digests only; payloads are cut in the JVM,
    so a Python task meets one piece at a time.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")
    )
    rows = rows.withColumn("size", F.octet_length("payload")).withColumn("sha1", F.sha1("payload"))
    firsts = rows.groupBy("sha1", "size").agg(F.min("page_id").alias("first"))
    typed = rows.join(firsts, ["sha1", "size"]).withColumn(
        "revisit",
        (F.col("size") >= least_revisit_bytes)
        & F.col("first").isNotNull()
        & ~F.col("page_id").eqNullSafe(F.col("first")),
    )
    pieces = F.when(F.col("revisit"), F.lit(0)).otherwise(
        F.ceil(F.col("size") / F.lit(chunk_bytes))
    )
    chunked = (
        typed.withColumn("row", F.monotonically_increasing_id())
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), pieces.cast("long"))))
        .select(
            "row", "page_id", "url", F.col("size").cast("long").alias("size"), "sha1", "first",
            "revisit", "chunk", pieces.cast("long").alias("last"),
            F.when(F.col("chunk") == 0, F.lit(None).cast("binary"))
            .otherwise(
                F.substring(
                    "payload", ((F.col("chunk") - 1) * chunk_bytes + 1).cast("int"),
                    F.lit(chunk_bytes),
                )
            )
            .alias("data"),
        )
    )

    def assemble(batches):
        import pyspark

        archive = pyspark.TaskContext.get().partitionId()
        running = hashlib.sha1()
        for batch in batches:
            names, numbers, data, marks = [], [], [], []
            columns = [c.to_pylist() for c in batch.columns]
            for row, page, url, size, sha, first, revisit, chunk, last, piece in zip(
                *columns, strict=True
            ):
                name = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{row}:{page}:{sha}"))
                if chunk == 0:
                    running = hashlib.sha1()
                    piece = record_head(
                        name, page, url, size, base32_sha1(bytes.fromhex(sha)), first, revisit, date
                    )
                else:
                    running.update(piece)
                names.append(name)
                numbers.append(chunk)
                data.append(piece + _END if chunk == last else piece)
                marks.append(running.hexdigest() if chunk else None)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([archive] * len(names), pa.int32()), pa.array(names, pa.string()),
                    pa.array(numbers, pa.int64()), pa.array(data, pa.binary()),
                    pa.array(marks, pa.string()),
                ],
                names=["archive", "record", "chunk", "data", "sha1_so_far"],
            )

    return chunked.mapInArrow(assemble, CHUNKS)


_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)\r?$", re.M)


class RecordReader:
    """Reads one record from consecutive pieces, keeping headers only."""

    def __init__(self):
        self._head = bytearray()
        self._fields: dict[bytes, bytes] | None = None
        self._http: dict[bytes, bytes] | None = None
        self._block_left = 0
        self._digest = hashlib.sha1()
        self.payload_read = 0

    def feed(self, data: bytes, mark: str | None = None) -> None:
        if self._http is None:
            self._head += data
            self._read_heads()
            data = bytes(self._head) if self._http is not None else b""
            self._head = bytearray() if self._http is not None else self._head
        body = data[: self._block_left]
        self._block_left -= len(body)
        self._digest.update(body)
        self.payload_read += len(body)
        if mark is not None and self._digest.hexdigest() != mark:
            raise ValueError("a chunk of a record is damaged or missing")

    def _read_heads(self) -> None:
        if self._fields is None:
            end = self._head.find(_END)
            if end < 0:
                return
            self._fields = {k.lower(): v for k, v in _FIELD.findall(bytes(self._head[:end]))}
            del self._head[: end + 4]
        end = self._head.find(_END)
        if end < 0:
            return
        self._http = {k.lower(): v for k, v in _FIELD.findall(bytes(self._head[:end]))}
        self._block_left = int(self._fields[b"content-length"]) - end - 4
        del self._head[: end + 4]

    def finish(self) -> tuple:
        """(page_id, url, payload_bytes, payload_digest, record_type, refers_to)."""
        if self._http is None or self._block_left:
            raise ValueError("a record ends before its length")
        fields = self._fields
        kind = fields[b"warc-type"].decode()
        digest = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
        if kind == "response":
            size, own = self.payload_read, base32_sha1(self._digest.digest())
            if own != digest:
                raise ValueError("a payload does not match its digest")
        else:
            size = int(self._http[b"content-length"])
        number, first = fields.get(b"page-number"), fields.get(b"page-number-referred")
        url, whole = fields.get(b"warc-target-uri"), fields.get(b"page-url")
        url = unquote(whole.decode()) if whole is not None else None if url is None else url.decode()
        return (
            None if number is None else int(number), url, size, digest, kind, None if first is None else int(first),
        )


_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("broken", pa.string()),
    ]
)


def _parse(batches: Iterable, strict: bool) -> Iterator[pa.RecordBatch]:
    """Rows of `_SCHEMA`; a record that does not read to its end raises, or is named in `broken`."""
    at: str | None = None
    reader: RecordReader | None = None

    def attempt(step):
        nonlocal reader
        try:
            return step()
        except (ValueError, KeyError):
            if strict:
                raise
            reader = None
            return None

    def close() -> list[tuple]:
        if at is None:
            return []
        row = attempt(reader.finish) if reader is not None else None
        return [(*row, None) if row else (*[None] * 6, at)]

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) if found else [[]] * len(_SCHEMA)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA
        )

    for batch in batches:
        found: list[tuple] = []
        for record, _, data, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if record != at:
                found += close()
                at, reader = record, RecordReader()
            if reader is not None:
                attempt(lambda d=data, m=mark: reader.feed(d, m))
        yield rows_of(found)
    yield rows_of(close())


def read_archives(chunks: DataFrame) -> DataFrame:
    """One row per record (`PAGES`) from chunk rows in any order.

    `chunks` should be a written table, as it is read twice. First each task reads
    its rows as they stand, as a stream: headers of one record and one batch of
    pieces. Records that do not end there, because a split or a file ends first or
    rows are out of order, are only named; their pieces alone are then brought
    together and read in order, and one that still does not end raises.
    """
    work = Workspace(chunks.sparkSession, "read-archives")
    pieces = chunks.select("record", "chunk", "data", "sha1_so_far")
    schema = f"{PAGES}, broken string"
    first = work.stage(pieces.mapInArrow(lambda rows: _parse(rows, False), schema), "first")
    # Written on its own, the list's size is known when the join is planned.
    named = first.filter("broken IS NOT NULL").select(F.col("broken").alias("record")).distinct()
    broken = work.stage(named, "broken")
    ordered = (
        pieces.join(broken, "record", "left_semi")
        .select("record", "chunk", "data", "sha1_so_far")
        .repartition("record")
        .sortWithinPartitions("record", "chunk")
    )
    second = ordered.mapInArrow(lambda rows: _parse(rows, True), schema)
    return first.filter("broken IS NULL").unionByName(second).drop("broken")


def archive_stream(rows: Iterable) -> Iterator[bytes]:
    """Bytes of one archive as a WARC file, from its chunk rows by record and chunk."""
    for row in rows:
        yield bytes(row["data"])


def round_trip(
    pages: DataFrame, least_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Writes all pages to archives and returns what reading them back gives.

    `pages` needs `page_id`, `url` and `html`; other columns are ignored. Null html
    is an empty payload. Rows that share the smallest `page_id` of a payload are
    all responses. A null `page_id` is stored as such: it revisits a page with an
    id if there is one, and is a response otherwise. A null url leaves the target
    out; control characters, blanks and characters beyond ASCII are percent-encoded in
    the target, and the url itself comes back as it was. An empty table gives no rows.
    """
    work = Workspace(pages.sparkSession, "archives")
    chunks = work.stage(write_archives(pages, least_revisit_bytes, chunk_bytes), "chunks", codec="zstd")
    return read_archives(chunks)
