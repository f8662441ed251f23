"""WARC archives with Zstandard: one frame per record, the dictionary in front.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself a frame. Every record is a frame of its own, so a reader can
start at any of them; empty skippable frames between them are passed over. The
reader checks versions, required headers, lengths, record ends and digests, and
raises ``ValueError`` with file and offset for whatever does not hold.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.files import read_bytes, work_folder, write_bytes
from tabforge.llm.registry import query
from tabforge.llm.vocab import column
from tabforge.sources.tables import load

#: Payloads from this size on are stored once.
SHARED_BYTES = 1000
#: The dictionary is trained on so many pages at most, and on so many signs of each.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 8192, 1 << 16
LEVEL = 6
DATE = "2000-01-01T00:00:00Z"

# Magics and names of the formats.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

_RECORD = (
    "file long, at long, record_type string, record_id string, target_uri string, page_id long,"
    " refers_to long, payload_bytes long, payload_digest string"
)


def record_id(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def record(page_id, url, html, digest, kind, refers_to) -> bytes:
    """One WARC record. A revisit holds the HTTP head only, which still tells the payload's length."""
    payload = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    content = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY, len(content)) + content


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, by its block headers."""
    try:
        known = zstandard.get_frame_parameters(data[at : at + 18])
        place = at + zstandard.frame_header_size(data[at : at + 18])
    except zstandard.ZstdError as error:
        raise ValueError(f"no frame header: {error}") from error
    last = False
    while not last:
        if place + 3 > len(data):
            raise ValueError("the frame is cut short")
        head = int.from_bytes(data[place : place + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        place += 3 + (1 if kind == 1 else size)
    place += 4 * known.has_checksum
    if place > len(data):
        raise ValueError("the frame is cut short")
    return place


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of every record frame of an archive."""
    data = memoryview(content)
    at, reader = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            if at + 8 > len(data):
                raise ValueError("the file ends inside a frame header")
            magic, size = struct.unpack_from("<II", data, at)
            if magic == FRAME:
                end = _frame_end(data, at)
                yield at, reader.decompressobj().decompress(data[at:end])
            elif SKIPPABLE <= magic <= SKIPPABLE + 15:
                end = at + 8 + size
                if end > len(data):
                    raise ValueError("a skippable frame is cut short")
                if magic == DICTIONARY and at == 0:
                    held = bytes(data[at + 8 : end])
                    if held[:4] == struct.pack("<I", FRAME):
                        held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            else:
                raise ValueError(f"unknown magic {magic:#x}")
        except (ValueError, zstandard.ZstdError) as error:
            raise ValueError(f"offset {at}: {error}") from error
        at = end


def _headers(text: bytes) -> dict[str, str]:
    out = {}
    for line in text.decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def parsed(raw: bytes) -> tuple[dict[str, str], int, str, bytes | None]:
    """(WARC headers, payload length, hex digest, payload or None) of one record, checked."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.\d+", version):
        raise ValueError(f"no WARC version line, but {version[:40]!r}")
    warc = _headers(lines)
    if missing := [name for name in REQUIRED if name not in warc]:
        raise ValueError(f"no {', '.join(missing)}")
    if not warc["content-length"].isdigit():
        raise ValueError("the content length is no number")
    length = int(warc["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, {length} are promised")
    kind = warc["warc-type"]
    if kind not in ("response", "revisit"):
        raise ValueError(f"unexpected record type {kind!r}")
    if kind == "revisit" and "warc-refers-to" not in warc:
        raise ValueError("a revisit that refers to nothing")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise ValueError("no HTTP head")
    size = int(_headers(lines).get("content-length", -1))
    name, _, coded = warc.get("warc-payload-digest", "").partition(":")
    if name != "sha1":
        raise ValueError("no SHA-1 payload digest")
    digest = base64.b32decode(coded).hex()
    if kind == "revisit":
        if payload:
            raise ValueError("a revisit with a payload")
        return warc, size, digest, None
    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("the payload is not what its length and digest say")
    return warc, size, digest, payload


def _writer(dictionary: bytes):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True)
        pending = [dictionary_frame(dictionary)] if dictionary else []
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                for row in batch.slice(first, 64).to_pylist():
                    fields = (row["page_id"], row["url"], row["html"], row["payload_digest"])
                    pending.append(coder.compress(record(*fields, row["record_type"], row["refers_to"])))
                yield pa.RecordBatch.from_arrays([pa.array(pending, pa.binary())], ["frame"])
                pending = []

    return write


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("file", pa.int64()), ("at", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
             ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
            + [("payload", pa.binary())] * with_payload
        )
        for batch in batches:
            for file, content in zip(column(batch, "file").to_pylist(), column(batch, "content")):
                rows = []
                try:
                    for at, raw in frames(content.as_buffer()):
                        warc, size, digest, payload = parsed(raw)
                        page, other = warc.get("x-page-id"), warc.get("x-refers-to-page")
                        rows.append(
                            (file, at, warc["warc-type"], warc["warc-record-id"], warc.get("warc-target-uri"),
                             page and int(page), other and int(other), size, digest, payload)[: len(schema)]
                        )
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                except ValueError as error:
                    raise ValueError(f"archive {file}: {error}") from error
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return read


def train(pages: DataFrame) -> bytes:
    """A dictionary from the ``SAMPLE_PAGES`` pages of smallest hash; empty if they are too few."""
    marked = pages.where("html <> ''").withColumn("mark", F.xxhash64("page_id", "url"))
    last = marked.select("mark").orderBy("mark").limit(SAMPLE_PAGES).agg(F.max("mark")).first()[0]
    sample = marked.where(F.col("mark") <= F.lit(last)).limit(SAMPLE_PAGES)
    rows = sample.select("mark", F.substring("html", 1, SAMPLE_CHARS).alias("html")).collect()
    rows.sort()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.html.encode() for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_warc(pages: DataFrame, path: str) -> None:
    """Write a record per row of ``pages`` (page_id, url, html); one archive per partition.

    Of rows with equal payloads of ``SHARED_BYTES`` or more, those with the largest
    page_id are responses and the others revisit it; all others are responses. A
    null html is empty. Null ids refer to the largest id, but are never referred to;
    if all ids of a payload are null, all are responses. Other columns are not
    looked at.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    dictionary = train(rows)
    rows = rows.withColumn("payload_digest", F.sha1(F.encode("html", "UTF-8"))).withColumn(
        "size", F.octet_length("html")
    )
    shared = (
        rows.where(F.col("size") >= SHARED_BYTES).groupBy("payload_digest", "size")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    typed = rows.join(shared, ["payload_digest", "size"], "left").select(
        "page_id", "url", "html", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )
    write_bytes(typed.mapInArrow(_writer(dictionary), "frame binary"), path)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record of the archives below ``path``."""
    schema = _RECORD + (", payload binary" if with_payload else "")
    return read_bytes(spark, path).mapInArrow(_reader(with_payload), schema)


SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
             max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {SHARED_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {SHARED_BYTES} AND page_id <> top THEN top END AS refers_to
FROM d"""


@query("op6_warc", SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "warc")
    write_warc(load(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
