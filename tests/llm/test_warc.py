"""Archives: round trips, damage, and what other Zstandard readers see."""

import hashlib
import struct

import pytest
import zstandard

from tabforge.llm import warc
from tabforge.llm.files import SEPARATOR, read_bytes, work_folder
from tests.oracle import connect, differences

LONG = "<p>" + "é👩‍👩‍👧 text " * 200
ROWS = [
    (1, "http://a/ b\r\nX: y", LONG), (5, None, LONG), (3, "u", LONG), (None, "n", LONG), (7, "u", None), (8, "u", ""),
    (9, "u", "short"), (10, "u", "short"), (11, "é", "x" * 1000), (12, "é", "x" * 1000), (13, "", "x" * 999), (14, "", "x" * 999),
    (20, "u", "a\r\n\r\nb" * 300), (21, "u", "y" * 3_000_000), (None, "m", "z" * 2000), (None, "m", "z" * 2000), (30, "v", LONG + "!"), (30, "v", LONG + "!"),
]


def expected(rows):
    out = []
    for key, _, html in rows:
        raw = (html or "").encode()
        top = max((k for k, _, h in rows if (h or "") == (html or "") and k is not None), default=None)
        again = len(raw) >= 1000 and top is not None and key != top
        out.append((key, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def written(spark, rows, parts=3):
    pages = spark.createDataFrame([(k, u, h, 1, "x") for k, u, h in rows], "page_id long, url string, html string, size int, first string")
    path = work_folder(spark, "warc-test")
    warc.write_warc(pages.repartition(parts), path)
    return path


def found(df):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in df.select(names).collect()), key=str)


def test_odd_rows(spark):
    path = written(spark, ROWS)
    assert found(warc.read_warc(spark, path)) == expected(ROWS)
    payloads = {r.page_id: bytes(r.payload).decode() for r in warc.read_warc(spark, path, True).collect() if r.record_type == "response"}
    assert all(payloads[k] == (h or "") for k, _, h in ROWS if k in (5, 7, 9, 12, 13, 20, 21))


def test_empty_table(spark):
    assert found(warc.read_warc(spark, written(spark, []))) == []


def test_dictionary_comes_first(spark):
    rows = [(k, f"http://x/{k}", f"<html><head><title>page {k}</title></head><body>" + "".join(f"<p class='c{j * k % 17}'>words {j * k}</p>" for j in range(60))) for k in range(300)]
    path = written(spark, rows, 1)
    assert found(warc.read_warc(spark, path)) == expected(rows)
    for row in read_bytes(spark, path).collect():
        content = bytes(row.content)
        magic, size = struct.unpack_from("<II", content)
        assert magic == warc.DICTIONARY and SEPARATOR in content
        kept = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(content[8 : 8 + size]))
        first = next(warc.frames(content))
        assert zstandard.ZstdDecompressor(dict_data=kept).decompressobj().decompress(content[first[0] :]) == first[1]
        with pytest.raises(ValueError):
            list(warc.frames(content[8 + size :]))


def test_damage_is_noticed():
    good = warc.record(1, "u", "payload", hashlib.sha1(b"payload").hexdigest(), "response", None)
    assert warc.parsed(good)[3] == b"payload"
    bad = [
        good[:-1], good + b"x", good.replace(b"payload\r", b"paxload\r"), good.replace(b"WARC/1.1", b"WARC 1.1"), good.replace(b"WARC-Date", b"Date"),
        good.replace(b"Type: response", b"Type: other"), good.replace(b"Type: response", b"Type: revisit"), good.replace(b"HTTP/1.1", b"XTTP/1.1"),
        good.replace(b"Content-Length: 7\r\n\r\n", b"Content-Length: 8\r\n\r\n"), b"",
    ]
    for raw in bad:
        with pytest.raises(ValueError):
            warc.parsed(raw)
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(good)
    assert [raw for _, raw in warc.frames(SEPARATOR + frame + SEPARATOR + frame)] == [good, good]
    for content in (frame[:-1], frame[:9], b"junkjunkjunk", frame[:12] + b"\xff" + frame[13:], frame + b"P*M"):
        with pytest.raises(ValueError):
            list(warc.frames(content))


def test_query_agrees_with_sql(spark, sf_dir):
    assert differences(warc.op6_warc(spark, sf_dir), connect(sf_dir), warc.SQL) == []
