"""Language ID with bit-sliced Bloom filters over character trigrams.

A trigram is three neighbouring signs of the lower-cased text, where whatever lies
between words counts as one gap. Training counts trigrams by language over all
training rows and keeps those that make up at least 1/``GRAMS`` of a language's
trigrams, hence no more than ``GRAMS`` of each. All languages share one filter: a
row of it is a bitmask with a bit per language, and the AND of a trigram's rows
names every language that (surely or falsely) holds it. Per text and language the
set bits are counted, the share expected from false positives is taken off, and the
largest count wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.registry import query
from tabforge.llm.tokens import Texts, mix, signed, texts
from tabforge.llm.vocab import column
from tabforge.sources.tables import load

GRAMS = 20_000
HASHES = 3
#: Rows of the filter per trigram of the language that has most.
ROOM = 16
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Which code points are letters; built once a worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter(
            (chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000
        )
    return _letters


def trigrams(block: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams (three code points of 21 bits, 0 for a gap), and where each text's begin."""
    raw = block.data
    bounds = block.bounds.tolist()
    lowered = [raw[a:b].tobytes().decode().lower() for a, b in zip(bounds[:-1], bounds[1:])]
    signs = np.frombuffer(("\n" + "\n".join(lowered) + "\n").encode("utf-32-le"), dtype="<u4")
    is_letter = letter_table()[signs]
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]
    ends = np.cumsum([len(t) + 1 for t in lowered])  # just behind each text's closing gap
    opens = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[1], ends + 1])]
    kept = np.where(is_letter, signs, 0)[keep].astype(np.uint64)
    if len(kept) < 3:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(lowered) + 1, dtype=np.int64)
    shift = np.uint64(21)
    middle = np.flatnonzero(kept[1:-1]) + 1
    grams = (((kept[middle - 1] << shift) | kept[middle]) << shift) | kept[middle + 1]
    return grams, np.searchsorted(middle, opens)


def _counts(names: list[str]):
    place = {name: k for k, name in enumerate(names)}

    def emit(found: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for k, name in enumerate(names):
            own = [(g, n) for lang, g, n in found if lang == k]
            if own:
                grams, back = np.unique(np.concatenate([g for g, _ in own]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([n for _, n in own])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(grams)), pa.array(signed(grams)), pa.array(n)],
                    ["lang", "gram", "n"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            langs = np.array([place[x] for x in column(batch, "lang").to_pylist()], dtype=np.int64)
            for block in texts(column(batch, "text")):
                grams, bounds = trigrams(block)
                own = np.repeat(langs[block.first : block.first + len(block)], np.diff(bounds))
                for k in np.unique(own).tolist():
                    seen, n = np.unique(grams[own == k], return_counts=True)
                    found.append((k, seen, n))
                    held += len(seen)
                if held > 1 << 21:
                    yield from emit(found)
                    found, held = [], 0
        yield from emit(found)

    return count


class Filter:
    """The learnt filter: languages in code point order, rows of bitmasks, false positives."""

    def __init__(self, names: list[str], grams: dict[str, np.ndarray]):
        self.names = names
        most = max((len(g) for g in grams.values()), default=1)
        self.size = 1 << max(6, (ROOM * most - 1).bit_length())
        slices = -(-max(len(names), 1) // 64)
        self.rows = np.zeros((slices, self.size), dtype=np.uint64)
        filled = np.zeros(len(names))
        for k, name in enumerate(names):
            bit = np.uint64(1 << (k % 64))
            for rows in self.places(grams[name]):
                self.rows[k // 64, rows] |= bit
            filled[k] = np.count_nonzero(self.rows[k // 64] & bit) / self.size
        self.false = filled**HASHES

    def places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        first, step = mix(grams), mix(grams ^ _GOLD) | np.uint64(1)
        for _ in range(HASHES):
            yield (first & np.uint64(self.size - 1)).astype(np.int64)
            first = first + step

    def holders(self, grams: np.ndarray) -> np.ndarray:
        """Per slice of 64 languages, the bitmask of the languages holding each trigram."""
        masks = None
        for rows in self.places(grams):
            found = self.rows[:, rows]
            masks = found if masks is None else masks & found
        return masks

    def decide(self, block: Texts) -> tuple[list[str], np.ndarray]:
        grams, bounds = trigrams(block)
        n = np.diff(bounds)
        if not self.names or not len(grams):
            return [UNKNOWN] * len(n), np.zeros(len(n))
        masks = self.holders(grams)
        votes = np.zeros((len(self.names), len(n)))
        for k in range(len(self.names)):
            bits = (masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)
            held = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
            counted = held[bounds[1:]] - held[bounds[:-1]]
            votes[k] = np.maximum(0, counted - n * self.false[k]) / (1 - self.false[k])
        best = np.argmax(votes, axis=0)
        total = votes.sum(axis=0)
        score = np.divide(votes.max(axis=0), total, out=np.zeros(len(n)), where=total > 0)
        return [self.names[k] if m else UNKNOWN for k, m in zip(best.tolist(), n.tolist())], score


def learn(docs: DataFrame, grams: int = GRAMS) -> Filter:
    """Learn from ``text`` and ``lang`` of all rows; rows without a lang or text are left out."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    names = sorted(r.lang for r in rows.select("lang").distinct().collect())
    counts = rows.mapInArrow(_counts(names), "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(totals, "lang").where(F.col("n") * grams >= F.col("total"))
    found = {name: [] for name in names}
    for row in kept.select("lang", "gram").collect():  # at most ``grams`` of a language
        found[row.lang].append(row.gram)
    return Filter(names, {k: np.array(sorted(v), dtype=np.int64).view(np.uint64) for k, v in found.items()})


def _decider(model):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in texts(column(batch, "text")):
                names, score = model.value.decide(block)
                rows = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays(
                    [column(rows, "doc_id"), column(rows, "held_out"), pa.array(names), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return decide


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; only ``text`` decides.

    A text that is null or has no letter is ``und`` with score 0, as is every text
    if nothing was learnt. Of equal counts the first language by code point wins.
    The score is the winner's share of all languages' counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "held_out", "text")
    return rows.mapInArrow(
        _decider(shared), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def folded(docs: DataFrame) -> DataFrame:
    """Add held_out; a row without an id is not held out."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang",
        F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
    )


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and predict all rows."""
    rows = folded(docs)
    return predict(rows, learn(rows.where("NOT held_out")))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))
