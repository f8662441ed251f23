"""Token-ID / binary output: Simple-8b files in ascending id order, and their reader.

Rows are dealt into ranges of ``doc_id`` and each range is coded into one file by
the task that holds it, so no ids are shuffled, only texts. A file is a row of
pieces, each closed by the eight bytes of ``files.SEPARATOR``; a piece is words of
64 bits, little-endian:

    magic, documents, ids, lanes, words
    doc_id per document | 1 if that doc_id is null, else 0 | ids per document
    first word of each lane (lanes + 1) | Simple-8b words

Every size is checked when read. ``start`` is summed over the files' totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.llm import simple8b
from tabforge.llm.files import SEPARATOR, read_bytes, work_folder, write_bytes
from tabforge.llm.registry import query
from tabforge.llm.tokens import texts
from tabforge.llm.vocab import coder, column
from tabforge.session import settle
from tabforge.sources.tables import load

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MAGIC = int.from_bytes(b"TFIDS001", "little")
HEAD = 5

_READ = "file long, row long, doc_id long, n_tokens long, ids_crc32 long"


def piece(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = simple8b.encode(ids)
    head = [MAGIC, len(doc_ids), len(ids), len(offsets) - 1, len(words)]
    parts = [np.array(head), doc_ids, nulls, counts, offsets, words.view(np.int64)]
    return np.concatenate([p.astype(np.int64) for p in parts]).astype("<i8").tobytes()


def pieces(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, nulls, ids per document, ids) of each piece of a file; damage raises."""
    if len(content) % 8:
        raise ValueError("the file is not made of whole words")
    words = np.frombuffer(content, dtype="<i8")
    closing = int(np.frombuffer(SEPARATOR, dtype="<i8")[0])
    at = 0
    while at < len(words):
        if at + HEAD > len(words) or words[at] != MAGIC:
            raise ValueError(f"no piece starts at word {at}")
        n_docs, n_ids, lanes, n_words = (int(x) for x in words[at + 1 : at + HEAD])
        cuts = at + HEAD + np.cumsum([0, n_docs, n_docs, n_docs, lanes + 1, n_words])
        if min(n_docs, n_ids, lanes, n_words) < 0 or cuts[-1] >= len(words):
            raise ValueError(f"the piece at word {at} is cut short")
        doc_ids, nulls, counts, offsets, coded = (
            words[a:b] for a, b in zip(cuts[:-1], cuts[1:])
        )
        if counts.sum() != n_ids or offsets[-1] != n_words or words[cuts[-1]] != closing:
            raise ValueError(f"the piece at word {at} does not add up")
        yield doc_ids, nulls, counts, simple8b.decode(coded.view(np.uint64), offsets, n_ids)
        at = int(cuts[-1]) + 1


def _writer(path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(path)
        for batch in batches:
            keys = column(batch, "doc_id")
            null = np.asarray(keys.is_null()).astype(np.int64)
            keys = np.asarray(keys.fill_null(0))
            for block in texts(column(batch, "text")):
                ids, bounds = known.code(block)
                ids = np.insert(ids.astype(np.uint64), bounds[1:], end_id)
                rows = slice(block.first, block.first + len(block))
                made = piece(keys[rows], null[rows], np.diff(bounds) + 1, ids)
                yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["piece"])

    return write


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(column(batch, "file").to_pylist(), column(batch, "content")):
            row = 0
            for keys, null, counts, ids in pieces(content.as_buffer().to_pybytes()):
                small = ids.astype("<u4")
                ends = np.cumsum(counts)
                crc = [
                    zlib.crc32(small[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())
                ]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, file)),
                        pa.array(np.arange(row, row + n)),
                        pa.array(keys, mask=null.astype(bool)),
                        pa.array(counts),
                        pa.array(crc, pa.int64()),
                    ],
                    ["file", "row", "doc_id", "n_tokens", "ids_crc32"],
                )
                row += n


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Code ``doc_id`` and ``text`` of all rows into files below ``path``.

    A null text is empty (its only id is the end id). A null doc_id comes first;
    rows of one doc_id are ordered by text. Other columns are not looked at.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    write_bytes(ordered.mapInArrow(_writer(tokenizer, end_id), "piece binary"), path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    rows = settle(read_bytes(spark, path).mapInArrow(_read, _READ))
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return (
        rows.withColumn("local", local)
        .join(totals, "file")
        .select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_binary(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write the files of all documents and read them back."""
    spark = docs.sparkSession
    path = path or work_folder(spark, "token-ids")
    write_ids(docs, path, tokenizer or public_tokenizers.path(TOKENIZER))
    return read_ids(spark, path)


@query("op7_token_binary")
def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(load(spark, sf_dir, "documents"))
