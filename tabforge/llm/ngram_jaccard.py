"""N-gram Jaccard join: which documents share at least three quarters of their shingles.

A document's set holds the hashes of its distinct five-word shingles. Equal sets
form a class and are handled once. The join of the classes is exact:

1. *Order.* Shingles are ordered by how full their counting cell is (all documents
   are counted, the array has a fixed size), rare ones first. Sets that are similar
   enough share a shingle among their first quarter in that one order.
2. *Tiles.* Classes meet by such a shingle and by size. A tile of up to ``TILE``
   classes is joined within. In larger ones, classes first meet a few others in
   random order, which ties groups of near copies together in linear work. What is
   not in one component then is compared in full, but inside a task: large tiles
   with the same smallest class are taken together, cut into bands of size and
   blocks of ``BLOCK`` shingles, and only links come out.
3. *Bitmaps.* Each class has a hashed bitmap whose width follows its size. A bit of
   one that the other lacks stands for at least one shingle it lacks, so the bit
   counts bound the overlap from above, and most pairs end here.
4. *Sets.* For the rest, the sorted hash arrays are intersected.

Two shingles of one comparison share a hash with odds of 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.llm.cells import bit_filter, cell_counts, cell_of, may_hold
from tabforge.llm.components import components
from tabforge.llm.registry import query
from tabforge.llm.tokens import (
    VISIBLE, Texts, chained, mix, packed, signed, span_hash, texts, unpacked, unsigned,
)
from tabforge.llm.vocab import column
from tabforge.session import settle
from tabforge.sources.tables import load

WIDTH = 5
TILE = 64
#: Shingles that one block of a large tile holds.
BLOCK = 1 << 19
#: Random partners in a large tile, the share of large tiles (1 of so many) that deals
#: them, and how many partners of a class are looked at exactly before the rest.
LAGS, EVERY, PARTNERS = 2, 8, 3
#: 2**CELL_BITS counting cells; add a bit whenever the shingles of a corpus outgrow
#: them a thousandfold, so that common passages still stand out.
CELL_BITS = 20
FILTER_BITS = 24

#: A shingle whose cell holds more is dealt into parts of about this size.
PART_ROWS = 200_000

_SIGNED = "doc_id long, c long, n int, prefix array<long>, parts array<int>, bits binary"
_MET = "a long, b long, h long, n int, i int, large boolean"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def least_overlap(n):
    """Smallest intersection that links two sets whose sizes add up to ``n``: 3/7 of it."""
    return -(-3 * n // 7)


def shingle_sets(block: Texts, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words make one shingle."""
    starts, lengths = block.lower().spans(VISIBLE)
    hashes = span_hash(block.data, starts, lengths)
    rolled = chained(hashes, width)
    bounds = block.per_text(starts).tolist()
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        else:
            out.append(chained(hashes[a:b], max(b - a, 1)))
    return out


def class_of(shingles: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), seed=len(shingles)) - 2**63


def bitmap(shingles: np.ndarray, room: int = 1) -> np.ndarray:
    """``room`` bits per shingle at least, a power of two, in 64-bit words."""
    size = max(64, 1 << (room * len(shingles) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(mix(shingles ^ _GOLD) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (one per row) brought down to fewer words."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _all_shingles(width: int):
    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for block in texts(column(batch, "text")):
            yield np.concatenate(shingle_sets(block, width))

    return hashes


def _signatures(counts, cell_bits: int, width: int):
    """Per row its class; the first of a class in this task also brings prefix and bitmap."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fullness = counts.value
        seen: set[int] = set()
        for batch in batches:
            ids = column(batch, "doc_id")
            for block in texts(column(batch, "text")):
                names, sizes, prefixes, parts, maps = [], [], [], [], []
                for own in shingle_sets(block, width):
                    n = len(own)
                    name = class_of(own) if n else None
                    names.append(name)
                    sizes.append(n)
                    if not n or name in seen:
                        prefixes.append(None)
                        parts.append(None)
                        maps.append(None)
                        continue
                    seen.add(name)
                    full = fullness[cell_of(own, cell_bits)]
                    first = np.argsort(full, kind="stable")[: n - -(-3 * n // 4) + 1]
                    cut = 1 + full[first].astype(np.int64) // PART_ROWS
                    prefixes.append(signed(own[first]))
                    parts.append(cut if cut.max() > 1 else None)
                    maps.append(bitmap(own).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(block.first, len(block)),
                        pa.array(names, pa.int64()),
                        pa.array(sizes, pa.int32()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                        pa.array(parts, pa.list_(pa.int32())),
                        pa.array(maps, pa.binary()),
                    ],
                    ["doc_id", "c", "n", "prefix", "parts", "bits"],
                )

    return sign


def _pairs(rows: np.ndarray, size: np.ndarray, tile: int, lags: int) -> np.ndarray:
    """Pairs of classes that meet in a tile: all in small ones, near neighbours in large ones.

    Rows are (h, parts, turn, c, n, i), tile by tile. A pair that is similar enough
    passes the test of places at the first shingle its two prefixes share.
    """
    out = [np.zeros((0, 2), dtype=np.int64)]
    h, turn, c, n, i = rows[:, 0], rows[:, 2], rows[:, 3], rows[:, 4], rows[:, 5]
    later = np.arange(1, len(rows))
    for lag in range(1, tile):
        later = later[later >= lag]
        if lag == 1:
            dealt = (h[later] >> 7) % EVERY == 0
            later = later[(size[later] <= tile) | dealt]
        elif lag == lags + 1:
            later = later[size[later] <= tile]
        early = later - lag
        same = (h[later] == h[early]) & (turn[later] == turn[early])
        later, early = later[same], early[same]
        if not len(later):
            break
        need = least_overlap(n[later] + n[early])
        fits = np.minimum(n[later] - i[later], n[early] - i[early]) >= need
        out.append(np.stack([c[early[fits]], c[later[fits]]], axis=1))
    pairs = np.concatenate(out)
    return np.unique(np.sort(pairs, axis=1), axis=0) if len(pairs) else pairs


def _meet(tile: int, lags: int):
    """Rows (h, parts, turn, c, n, i) sorted by tile -> pairs, and the members of large tiles."""
    kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.bool_()]

    def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = rows[:, [0, 2]]
        new = np.ones(len(rows), dtype=bool)  # a class may come from several tasks
        new[1:] = np.any(key[1:] != key[:-1], axis=1) | (rows[1:, 3] != rows[:-1, 3])
        rows, key = rows[new], key[new]
        opens = np.flatnonzero(np.concatenate([[True], np.any(key[1:] != key[:-1], axis=1)]))
        counts = np.diff(np.append(opens, len(rows)))
        size = np.repeat(counts, counts)
        shared = (size > 1) | (rows[:, 1] > 1)
        rows, size = rows[shared], np.where(rows[:, 1] > 1, tile + 1, size)[shared]
        pairs, large = _pairs(rows, size, tile, lags), rows[size > tile]
        none = np.zeros(len(pairs), dtype=np.int64)
        values = [
            np.concatenate([pairs[:, 0], large[:, 3]]),
            np.concatenate([pairs[:, 1], large[:, 3]]),
            np.concatenate([none, large[:, 0]]),
            np.concatenate([none, large[:, 4]]),
            np.concatenate([none, large[:, 5]]),
            np.arange(len(pairs) + len(large)) >= len(pairs),
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v).cast(k) for v, k in zip(values, kinds)], ["a", "b", "h", "n", "i", "large"]
        )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the tile that the next batch may go on with
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(k), dtype=np.int64) for k in range(6)], axis=1)
            if not len(rows):
                continue
            last = int(np.flatnonzero(np.any(rows[:, [0, 2]] != rows[-1, [0, 2]], axis=1))[-1:].sum())
            cut = last + 1 if np.any(rows[0, [0, 2]] != rows[-1, [0, 2]]) else 0
            if cut or (held and np.any(held[-1][-1, [0, 2]] != rows[-1, [0, 2]])):
                yield from work(np.concatenate([*held, rows[:cut]]))
                held = []
            held.append(rows[cut:])
        if held:
            yield from work(np.concatenate(held))

    return meet


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop pairs whose bitmaps bound the overlap below what a link needs."""
    for batch in batches:
        n_a, n_b = (np.asarray(column(batch, k), dtype=np.int64) for k in ("n_a", "n_b"))
        bits_a, cut_a = unpacked(column(batch, "bits_a"), "u8")
        bits_b, cut_b = unpacked(column(batch, "bits_b"), "u8")
        words_a, words_b = np.diff(cut_a), np.diff(cut_b)
        bound = np.zeros(len(n_a), dtype=np.int64)
        for wide_a, wide_b in np.unique(np.stack([words_a, words_b], axis=1), axis=0).tolist():
            at = np.flatnonzero((words_a == wide_a) & (words_b == wide_b))
            words = min(wide_a, wide_b)
            left = _fold(bits_a[cut_a[at][:, None] + np.arange(wide_a)], words)
            right = _fold(bits_b[cut_b[at][:, None] + np.arange(wide_b)], words)
            only_a = np.bitwise_count(left & ~right).sum(axis=1, dtype=np.int64)
            only_b = np.bitwise_count(right & ~left).sum(axis=1, dtype=np.int64)
            bound[at] = np.minimum(n_a[at] - only_a, n_b[at] - only_b)
        keep = np.flatnonzero(bound >= least_overlap(n_a + n_b))
        yield pa.RecordBatch.from_arrays(
            [column(batch, k).take(pa.array(keep)) for k in ("a", "b", "seen")], ["a", "b", "seen"]
        )


_TILE = ["hub", "span", "low", "high"]
_MEMBER = ["c", "n", "band", "block", "label", "shingles"]


def _tile_links(rows: pa.Table) -> list[tuple[int, int]]:
    """Links of one tile that tie different labels together, enough of them to do so.

    Bitmaps with eight bits per shingle sort out pairs, a block of rows at a time;
    what is left is intersected unless both ends have come together meanwhile.
    """
    c, n, band, block, label = (
        np.asarray(rows[k].combine_chunks(), dtype=np.int64) for k in _MEMBER[:5]
    )
    span, low, high = (rows[k][0].as_py() for k in _TILE[1:])
    flat, cuts = unpacked(rows["shingles"].combine_chunks(), "u8")
    sets = [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    wide = [bitmap(s, 8) for s in sets]
    words = min(map(len, wide))
    maps = np.concatenate([_fold(w[None], words) for w in wide])
    filled = np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    names, label = np.unique(label, return_inverse=True)
    top = list(range(len(names)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    few = np.flatnonzero(label != np.argmax(np.bincount(label)))  # two of the largest need no look
    step = max(1, (1 << 20) // (len(c) * words))
    out = []
    for first in range(0, len(few), step):
        a = few[first : first + step]
        both = np.bitwise_count(maps[a][:, None, :] & maps[None]).sum(axis=2, dtype=np.int64)
        bound = np.minimum(n[a][:, None] - filled[a][:, None], (n - filled)[None]) + both
        may = bound >= least_overlap(n[a][:, None] + n[None])
        may &= label[a][:, None] != label[None]
        may &= np.minimum(band[a][:, None], band[None]) == span
        if low != high:
            may &= block[a][:, None] != block[None]
        left, right = np.nonzero(may)
        for x, y in zip(a[left].tolist(), right.tolist()):
            label_x, label_y = find(label[x]), find(label[y])
            if label_x != label_y and _overlap(sets[x], sets[y]) >= least_overlap(n[x] + n[y]):
                top[max(label_x, label_y)] = min(label_x, label_y)
                out.append((int(c[x]), int(c[y])))
    return out


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile -> links."""

    def emit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _tile_links(pa.Table.from_batches(parts))
        ends = [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([np.asarray(column(batch, k), dtype=np.int64) for k in _TILE], axis=1)
        opens = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        cuts = [0, *opens.tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            now = tuple(keys[a].tolist())
            if held and now != last:
                yield from emit(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield from emit(held)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[place] == a))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose sorted arrays share enough."""
    for batch in batches:
        set_a, cut_a = unpacked(column(batch, "set_a"), "u8")
        set_b, cut_b = unpacked(column(batch, "set_b"), "u8")
        keep = []
        for row in range(batch.num_rows):
            a, b = set_a[cut_a[row] : cut_a[row + 1]], set_b[cut_b[row] : cut_b[row + 1]]
            if _overlap(a, b) >= least_overlap(len(a) + len(b)):
                keep.append(row)
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [column(batch, "a").take(rows), column(batch, "b").take(rows)], ["a", "b"]
        )


def _sets(wanted, width: int):
    """(c, shingles) of the classes the filter lets through, once a task."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in texts(column(batch, "text")):
                names, sets = [], []
                for own in shingle_sets(block, width):
                    name = class_of(own) if len(own) else None
                    if name is None or name in seen:
                        continue
                    if may_hold(wanted.value, unsigned([name]))[0]:
                        seen.add(name)
                        names.append(name)
                        sets.append(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), packed(sets)], ["c", "shingles"]
                )

    return collect


class _Join:
    """The join of one table: what its steps share."""

    def __init__(self, docs: DataFrame, width: int, tile: int, cell_bits: int):
        self.docs, self.width, self.tile, self.cell_bits = docs, width, tile, cell_bits
        self.context = docs.sparkSession.sparkContext
        self.sets: DataFrame | None = None

    def sign(self) -> DataFrame:
        counts = cell_counts(self.docs, _all_shingles(self.width), self.cell_bits)
        counts = self.context.broadcast(counts.astype(np.float32))
        return settle(self.docs.mapInArrow(_signatures(counts, self.cell_bits, self.width), _SIGNED))

    def meet(self, signed_rows: DataFrame) -> DataFrame:
        """Pairs to look at, and the members of large tiles."""
        rows = signed_rows.where("prefix IS NOT NULL").select(
            "c", "n", "parts", F.posexplode("prefix").alias("i", "h")
        )
        parts = F.coalesce(F.try_element_at("parts", F.col("i") + 1), F.lit(1))
        turn = F.pmod(F.xxhash64("h", "c"), parts)
        rows = rows.select("h", parts.alias("parts"), turn.alias("turn"), "c", "n", "i")
        tiles = rows.repartition("h", "turn").withColumn("mark", F.xxhash64("c", "h"))
        tiles = tiles.sortWithinPartitions("h", "turn", "mark").drop("mark")
        return settle(tiles.mapInArrow(_meet(self.tile, LAGS), _MET))

    def prune(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, seen) that the bitmaps let through."""
        own = self.classes.select("c", "n", "bits")
        left = own.select(F.col("c").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
        right = own.select(F.col("c").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
        return pairs.join(left, "a").join(right, "b").mapInArrow(_may_link, "a long, b long, seen long")

    def fetch(self, wanted: DataFrame) -> None:
        """Sort out the shingle sets of the classes (c) that later steps may look at."""
        known = self.context.broadcast(bit_filter(wanted, "c", FILTER_BITS))
        found = self.docs.select("text").mapInArrow(_sets(known, self.width), "c long, shingles binary")
        self.sets = settle(found.join(wanted, "c", "left_semi").dropDuplicates(["c"]))

    def verify(self, pairs: DataFrame) -> DataFrame:
        left = self.sets.select(F.col("c").alias("a"), F.col("shingles").alias("set_a"))
        right = self.sets.select(F.col("c").alias("b"), F.col("shingles").alias("set_b"))
        return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_linked, "a long, b long")

    def links(self, signed_rows: DataFrame) -> DataFrame:
        """Links between classes (a, b) whose components are those of all links."""
        self.classes = settle(
            signed_rows.where("prefix IS NOT NULL").groupBy("c").agg(
                F.first("n").alias("n"), F.first("bits").alias("bits")
            )
        )
        met = self.meet(signed_rows)
        pairs = met.where("NOT large").groupBy("a", "b").agg(F.count("*").alias("seen"))
        pairs = settle(self.prune(pairs))
        members = met.where("large").select("h", F.col("a").alias("c"), "n").distinct()
        ends = pairs.select(F.explode(F.array("a", "b")).alias("c"))
        self.fetch(ends.unionByName(members.select("c")).distinct())

        turn = Window.partitionBy("a").orderBy(F.desc("seen"), "b")
        few = pairs.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= PARTNERS)
        found = settle(self.verify(few))
        label = settle(components(found))
        rest = self.verify(self.apart(pairs.select("a", "b"), label))
        return found.unionByName(rest).unionByName(self.compared(members, label))

    def apart(self, pairs: DataFrame, label: DataFrame) -> DataFrame:
        """Pairs whose ends are not in one component."""
        ends = {}
        for end in ("a", "b"):
            ends[end] = label.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
        both = pairs.join(ends["a"], "a", "left").join(ends["b"], "b", "left")
        return both.where(
            F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
        ).select("a", "b")

    def compared(self, members: DataFrame, label: DataFrame) -> DataFrame:
        """Links within large tiles between what is not in one component."""
        own = members.join(label.withColumnRenamed("node", "c"), "c", "left").select(
            "h", "c", "n", F.coalesce("label", "c").alias("label")
        )
        mixed = own.groupBy("h").agg(
            F.min("c").alias("hub"), F.min("label").alias("low"), F.max("label").alias("high")
        ).where("low <> high").select("h", "hub")
        own = own.join(mixed, "h").select("hub", "c", "n", "label").distinct()
        blocks = own.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
        band = F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int")  # at most one apart if linked
        rows = own.join(blocks, "hub").join(self.sets, "c").select(
            "hub", "c", "n", band.alias("band"),
            F.pmod(F.xxhash64("c"), "blocks").cast("int").alias("block"), "label", "shingles", "blocks",
        )
        rows = rows.withColumn("span", F.explode(F.array(F.col("band") - 1, F.col("band"))))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select(
            "hub", "span", F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"), *_MEMBER,
        )
        tiles = rows.repartition(*_TILE).sortWithinPartitions(*_TILE)
        return tiles.mapInArrow(_tiles, "a long, b long")


def jaccard_join(
    docs: DataFrame, width: int = WIDTH, tile: int = TILE, cell_bits: int = CELL_BITS
) -> tuple[DataFrame, DataFrame]:
    """(membership, links): doc_id, n_shingles, class and component; links between classes.

    One membership row per input row. Equal sets share a class. ``component_id`` is
    the smallest doc_id of the component; null ids are passed over, so it is null
    only where all ids are. A row without words is alone: its component is its own
    id, its class is null. Rows of one id are told apart by their sets. Other columns
    are not looked at. Links are enough of all linked pairs to have their components.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    join = _Join(docs, width, tile, cell_bits)
    rows = join.sign()
    links = settle(join.links(rows).distinct())
    label = components(links)
    classes = rows.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("low"))
    named = classes.join(label.withColumnRenamed("node", "c"), "c", "left").withColumn(
        "label", F.coalesce("label", "c")
    )
    lowest = named.groupBy("label").agg(F.min("low").alias("lowest"))
    named = named.join(lowest, "label").select("c", F.col("label").alias("component"), "lowest")
    membership = rows.select("doc_id", "c", "n").join(named, "c", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id"),
        F.col("c").alias("class"),
    )
    return membership, links


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component: its smallest id, with the input's columns.

    Of repeated rows (same id and text) one stays. Where rows of one id have
    different texts, those of them whose component it is the smallest id of stay.
    """
    membership, _ = jaccard_join(docs)
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")
    first = membership.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(named).distinct()
    rows = docs.select(F.struct("*").alias("row"), named)
    turn = Window.partitionBy("key", "mark").orderBy("key")
    rows = rows.join(first, "key").withColumn("mark", F.xxhash64("row.text"))
    return rows.withColumn("turn", F.row_number().over(turn)).where("turn = 1").select("row.*")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: All documents meet by the shingles they share, so this is for small tables only.
SQL = f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
  WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i + 1:i + {WIDTH}], ' ')) AS s
      FROM w, unnest(range(0, greatest(len(w) - {WIDTH - 1}, 1))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (s)
      WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS other FROM both_ways UNION
          SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
c AS (SELECT node, min(other) AS low FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id"""


@query("op2_ngram_jaccard", SQL)
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    membership, _ = jaccard_join(load(spark, sf_dir, "documents"))
    return membership.drop("class")
