"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is ``size`` consecutive words of an item (a shorter item is one window).
A document holds a window only if it holds all of the window's shingles, so one
shingle, the rarest over all documents, is prefix enough: documents hand out only
the places of those shingles, thinned by a bit filter of fixed size. A place joins
its windows by shingle; the window's length and the place of the shingle in it say
where it must start and end; then the words themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.llm.cells import bit_filter, may_hold
from tabforge.llm.registry import query
from tabforge.llm.tokens import ALNUM, Texts, chained, signed, span_hash, texts
from tabforge.llm.vocab import column
from tabforge.session import settle
from tabforge.sources.tables import load

SIZE = 10
SHINGLE = 3
FILTER_BITS = 24
#: What separates words, as a Java pattern: everything that ``tokens.ALNUM`` leaves out.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_WINDOWS = "item_id long, n int, k int, win string, hashes array<long>"
_PLACES = (
    "doc_id long, copy long, n_words long, pos long, first long, k int, h long, words string"
)


def _text(block: Texts, starts, lengths, a: int, b: int) -> str:
    """The words a..b-1 joined by single spaces."""
    return b" ".join(
        block.data[s : s + n].tobytes() for s, n in zip(starts[a:b].tolist(), lengths[a:b].tolist())
    ).decode()


def _windows(size: int, shingle: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = column(batch, "item_id").to_pylist()
            rows = []
            for block in texts(column(batch, "text")):
                starts, lengths = block.lower().spans(ALNUM)
                hashes = span_hash(block.data, starts, lengths)
                bounds = block.per_text(starts)
                for t, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    if a == b:
                        continue
                    n = min(size, b - a)
                    k = min(shingle, n)
                    found = signed(chained(hashes[a:b], k))
                    for w in range(b - a - n + 1):
                        win = _text(block, starts, lengths, a + w, a + w + n)
                        own = found[w : w + n - k + 1].tolist()
                        rows.append((items[block.first + t], n, k, win, own))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int64())]
                names = ["item_id", "n", "k", "win", "hashes"]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def _places(block: Texts, known: np.ndarray, widths: list[int]):
    """(starts, lengths, text bounds, [(k, places, hashes) that the filter lets through])."""
    starts, lengths = block.lower().spans(ALNUM)
    hashes = span_hash(block.data, starts, lengths)
    bounds = block.per_text(starts)
    found = []
    for k in widths:
        rolled = chained(hashes, k)
        at = np.flatnonzero(may_hold(known, rolled))
        inside = np.searchsorted(bounds, at, side="right")
        at = at[at + k <= bounds[inside]]  # a shingle does not reach into the next text
        found.append((k, at, rolled[at]))
    return starts, lengths, bounds, found


def _count(known, widths: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in texts(column(batch, "text")):
                for k, _, hashes in _places(block, known.value, widths)[3]:
                    seen, n = np.unique(hashes, return_counts=True)
                    if len(seen):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(seen), k, np.int32)), pa.array(signed(seen)), pa.array(n)],
                            ["k", "h", "seen"],
                        )

    return count


def copies_of(block: Texts) -> list[int]:
    """Hash of each whole text, the same as Spark's xxhash64."""
    marks = [
        xxhash.xxh64_intdigest(block.data[a:b].tobytes(), seed=42)
        for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist())
    ]
    return signed(np.array(marks, dtype=np.uint64)).tolist()


def _candidates(known, widths: list[int], size: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.string()]
        names = ["doc_id", "copy", "n_words", "pos", "first", "k", "h", "words"]
        for batch in batches:
            ids = column(batch, "doc_id").to_pylist()
            for block in texts(column(batch, "text")):
                copies = copies_of(block)
                starts, lengths, bounds, found = _places(block, known.value, widths)
                own = ids[block.first : block.first + len(block)]
                rows = [
                    (key, copy, n, None, None, None, None, None)
                    for key, copy, n in zip(own, copies, np.diff(bounds).tolist())
                ]
                for k, at, hashes in found:
                    which = (np.searchsorted(bounds, at, side="right") - 1).tolist()
                    for t, p, h in zip(which, at.tolist(), signed(hashes).tolist()):
                        low, high = int(bounds[t]), int(bounds[t + 1])
                        a, b = max(low, p - size + 1), min(high, p + size)
                        words = _text(block, starts, lengths, a, b)
                        rows.append((own[t], copies[t], high - low, p - low, a - low, k, h, words))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return find


def rarest_shingles(windows: DataFrame, docs: DataFrame, bits: int) -> DataFrame:
    """(win, n, k, h, offset): of each distinct window the shingle that is rarest over all rows."""
    spark = docs.sparkSession
    each = windows.select(
        "win", "n", "k", F.posexplode("hashes").alias("offset", "h")
    ).dropDuplicates(["win", "offset"])
    widths = sorted(r.k for r in windows.select("k").distinct().collect())  # at most SHINGLE values
    known = spark.sparkContext.broadcast(bit_filter(each, "h", bits))
    seen = (
        docs.mapInArrow(_count(known, widths), "k int, h long, seen long")
        .groupBy("k", "h")
        .agg(F.sum("seen").alias("seen"))
    )
    ranked = each.join(seen, ["k", "h"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
    best = F.min(F.struct("seen", "h", "offset")).alias("best")
    return ranked.groupBy("win", "n", "k").agg(best).select(
        "win", "n", "k", F.col("best.h").alias("h"), F.col("best.offset").alias("offset")
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, size: int = SIZE, shingle: int = SHINGLE,
    filter_bits: int = FILTER_BITS,
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, hits). Hits are (doc_id, copy, start, n, win), one per occurrence.

    A verdict per input row: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated. Null texts have no words. Rows that share doc_id and text get the
    same verdict; rows of one doc_id with different texts are told apart. Items
    without words have no windows; an item with a null id hits words but is not
    counted as an item; repeated items count once. Other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text"))
    windows = settle(items.mapInArrow(_windows(size, shingle), _WINDOWS))
    rarest = settle(rarest_shingles(windows, docs, filter_bits))
    widths = sorted(r.k for r in rarest.select("k").distinct().collect())
    known = spark.sparkContext.broadcast(bit_filter(rarest, "h", filter_bits))
    found = settle(docs.mapInArrow(_candidates(known, widths, size), _PLACES))

    start = F.col("pos") - F.col("offset")
    own = F.slice(F.split("words", " "), (start - F.col("first") + 1).cast("int"), F.col("n"))
    hits = (
        found.where("pos IS NOT NULL")
        .join(rarest, ["k", "h"])
        .where((start >= 0) & (start + F.col("n") <= F.col("n_words")))
        .where(F.array_join(own, " ") == F.col("win"))
        .select("doc_id", "copy", start.alias("start"), "n", "win")
        .distinct()
    )
    hits = settle(hits)

    by_place = Window.partitionBy("doc_id", "copy").orderBy("start")
    reached = F.max(F.col("start") + F.col("n")).over(
        by_place.rowsBetween(Window.unboundedPreceding, -1)
    )
    covered = (
        hits.groupBy("doc_id", "copy", "start").agg(F.max("n").alias("n"))
        .withColumn("reached", F.coalesce(reached, F.lit(0)))
        .withColumn("fresh", F.col("start") + F.col("n") - F.greatest("start", "reached"))
        .groupBy("doc_id", "copy")
        .agg(F.sum(F.greatest("fresh", F.lit(0))).alias("n_hit"))
    )
    held = (
        hits.select("doc_id", "copy", "win").distinct()
        .join(windows.select("win", "item_id").distinct(), "win")
        .groupBy("doc_id", "copy")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    rows = found.where("pos IS NULL").select("doc_id", "copy", "n_words")
    for part in (covered, held):
        part = part.withColumnsRenamed({"doc_id": "_doc_id", "copy": "_copy"})
        same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("copy") == F.col("_copy"))
        rows = rows.join(part, same, "left").drop("_doc_id", "_copy")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    verdicts = rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
    return verdicts, hits


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The input rows that hold no window of an item, with the input's columns."""
    hits = decontaminate(docs, benchmark)[1].select(
        F.col("doc_id").alias("_doc_id"), F.col("copy").alias("_copy")
    ).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.xxhash64("text") == F.col("_copy"))
    return docs.join(hits, same, "left_anti")


def words_sql(column: str, pattern: str = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") -> str:
    """DuckDB: the words of a text once A-Z are lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = f"translate(coalesce({column}, ''), '{upper}', '{upper.lower()}')"
    return f"regexp_extract_all({lowered}, '{pattern}')"


SQL = f"""WITH iw AS (SELECT item_id, {words_sql('text')} AS w FROM benchmark),
items AS (SELECT item_id, w, len(w) AS m, least(len(w), {SIZE}) AS n FROM iw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1:s + n], ' ') AS win
         FROM items, unnest(range(0, m - n + 1)) AS r(s)),
dw AS (SELECT doc_id, {words_sql('text')} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT doc_id, s, n, array_to_string(w[s + 1:s + n], ' ') AS win
          FROM dw, sizes, unnest(range(0, len(w) - n + 1)) AS r(s) WHERE len(w) >= n),
hits AS (SELECT doc_id, s, n, item_id FROM spots JOIN wins USING (win, n)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM hits, unnest(range(s, s + n)) AS r(p) GROUP BY 1),
held AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hits GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(array_to_string(coalesce(ids, []), ',')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN held USING (doc_id)"""


@query("op9_decontaminate", SQL)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))[0]
