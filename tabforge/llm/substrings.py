"""Substring dedup with compact windows: passages that documents share, even slightly changed.

A document is the sequence of its distinct five-word shingles, each at its first
place. Under one hash function, the Cartesian tree over the sequence's hashes cuts
all subsequences of ``least`` shingles or more into compact windows (low, at, high):
each subsequence that starts in [low, at] and ends in [at, high] has its smallest
hash at ``at``. Only nodes whose window is that long are kept, about two per
``least`` shingles, and they are found without building the tree: a node is the
minimum of some run of ``least`` hashes, and its window ends where a smaller hash
stands.

A passage of two texts consists of shingles that two texts hold, three quarters of
all between its ends. So the shingles held twice are known first, by a filter, and
only stretches as dense as that go on, with their places and numbers in the text:
windows with too few of them, and texts without any, can have no passage.

Windows meet by hash and function, and all texts of a group are compared. Subsequences
of Jaccard similarity s meet under each function with probability s, so those at 0.75
are missed under all ``FUNCTIONS`` in 0.4 % of cases; equal ones never. Groups with one
smallest member hold much the same texts: they are joined, a text's windows there
become one slice, and the slices are cut into blocks. Those of two blocks are compared
within a task. Shingles in no other slice of the task, and stretches too short for a
passage without them, are put aside first. Pairs that share too little, or whose
passages could add neither a place nor a tie to those found, are passed over; all
others are compared shingle by shingle.

Equal passages do not depend on windows. Every run of
``least_words`` words has a hash and a smallest shingle. Shingles that are the
smallest of a run in two texts or more are known first, then the runs with such a
shingle meet by their hash, at all their places: whoever holds a run that another
text holds has it reported, however often either repeats it or a part of it.

Equal texts are one class: of each only the row with the smallest id goes on, wherever
the others are, and is compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.llm.cells import bit_filter, may_hold, twice_filter
from tabforge.llm.components import components
from tabforge.llm.registry import query
from tabforge.llm.tokens import (
    VISIBLE, Texts, chained, mix, packed, ranges, signed, span_hash, texts, unpacked, unsigned,
)
from tabforge.llm.vocab import column
from tabforge.session import settle
from tabforge.sources.tables import load

WIDTH = 5
LEAST_WORDS = 50
FUNCTIONS = 4
#: The words in slices that one block of a group holds.
BLOCK = 1 << 18
#: 64-bit words that the bit rows of two blocks may take; beyond that shingles share bits.
BIT_WORDS = 1 << 22
#: A window that has met so many others is measured against all further ones, so many at once and so many shingles.
MANY, AT_ONCE, CELLS = 8, 1024, 1 << 18
#: Passages of a stretch whose shingles are known apart; those of further ones always count as free.
SLOTS = 3
#: Shared shingles further apart than this are in different passages; one changed
#: word parts them by ``WIDTH``.
GAP = 3 * WIDTH + 1
#: Words between two similar passages whose shingles are no further apart: they are one.
SLACK = GAP - WIDTH
FILTER_BITS = 24
#: Shingles that are the smallest of runs in several texts, and all that several texts hold; both only thin out work.
RUN_BITS, HELD_BITS = 27, 27
#: The latter filter has about a bit for each word, up to so many bits: 64 MB for each Python worker.
MOST_HELD_BITS = 29
#: Knows one row of each class; a few others may pass, which only repeats work.
FIRST_BITS = 27
#: Runs of a shingle that is more often the smallest are dealt one by one, which bounds a task.
HOT = 100_000
_NO_ID = 2**63 - 1

_MET = "a long, b long, f int, low_a int, high_a int, low_b int, high_b int, large boolean"
_PASSAGE = "a long, b long, start_a long, stop_a long, start_b long, stop_b long, shared long"
_SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64) for k in range(FUNCTIONS)]


def sequences(block: Texts) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(class, words, distinct shingles in order, their places) of each text."""
    data = block.used
    names = [
        xxhash.xxh64_intdigest(data[a:b].tobytes()) - 2**63
        for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist())
    ]
    starts, lengths = block.lower().spans(VISIBLE)
    rolled = chained(span_hash(block.data, starts, lengths), WIDTH)
    bounds = block.per_text(starts).tolist()
    for name, a, b in zip(names, bounds[:-1], bounds[1:]):
        found, place = np.unique(rolled[a : max(a, b - WIDTH + 1)], return_index=True)
        order = np.argsort(place)
        yield name, b - a, found[order], place[order]


def compact_windows(hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, at, high) of the windows of ``least`` places or more.

    Several sequences may follow each other with a zero in front of each and behind
    the last; all other hashes are positive and differ within a sequence.
    """
    levels = [hashes]  # levels[k][i]: minimum of the 2**k hashes from i on
    while (1 << len(levels)) <= len(hashes):
        half = levels[-1]
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(half[:-step], half[step:]))
    if least > len(hashes):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    top = least.bit_length() - 1
    rest = least - (1 << top)
    run_min = np.minimum(levels[top][: len(hashes) - least + 1], levels[top][rest : rest + len(hashes) - least + 1])
    # A place is a node if the largest minimum of the runs over it is its own hash.
    largest = np.zeros(len(hashes) + least - 1, dtype=np.uint64)
    largest[least - 1 : least - 1 + len(run_min)] = run_min
    for k in range(top):
        step = 1 << k
        largest = np.maximum(largest[:-step], largest[step:])
    if rest:
        largest = np.maximum(largest[: len(largest) - rest], largest[rest:])
    at = np.flatnonzero((largest[: len(hashes)] == hashes) & (hashes > 0))
    own = hashes[at]
    low, high = at.copy(), at.copy()
    for k in reversed(range(len(levels))):
        step, level = 1 << k, levels[k]
        before = low - step
        wider = before >= 0
        wider[wider] = level[before[wider]] > own[wider]
        low[wider] -= step
        behind = high + 1
        wider = behind < len(level)
        wider[wider] = level[behind[wider]] > own[wider]
        high[wider] += step
    return low, at, high


def _all_shingles(least: int, firsts=None):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        seen: set[int] = set()  # a class counts once a task
        for batch in batches if firsts is None else _kept_rows(batches, firsts):
            for block in texts(column(batch, "text")):
                for name, _, shingles, _ in sequences(block):
                    if len(shingles) >= least and name not in seen:
                        seen.add(name)
                        yield shingles

    return found


def dense(text: np.ndarray, place: np.ndarray, nth: np.ndarray, least: int) -> np.ndarray:
    """Which shingles held twice are in a stretch that may be one side of a passage.

    Given are the text of each, its place and its number in the text's sequence, in
    order. A stretch has three quarters of ``least`` at least, no two neighbours are
    further apart than ``GAP``, and it has three quarters of all shingles between its ends.
    """
    lag, n = -(-3 * least // 4) - 1, len(text)
    if n <= lag:
        return np.zeros(n, dtype=bool)
    parts = (text[1:] != text[:-1]) | (place[1:] - place[:-1] > GAP)
    far = 8 * (n + int(nth.max()) + 1)  # nothing reaches from one part to the next
    # From x to y the stretch is dense if gain[y] + 1 >= gain[x].
    gain = 4 * np.arange(n) - 3 * nth.astype(np.int64) - far * np.concatenate([[0], np.cumsum(parts)])
    best = np.maximum.accumulate(gain[::-1])[::-1]
    begins = np.zeros(n, dtype=bool)
    begins[: n - lag] = best[lag:] + 1 >= gain[: n - lag]
    count = np.concatenate([[0], np.cumsum(begins)])
    out = count[1:] > count[np.maximum(np.arange(n) - lag, 0)]
    out[lag:] |= np.minimum.accumulate(gain)[: n - lag] <= best[lag:] + 1
    return out


def _dense_sequences(
    block: Texts, seen: set[int], held: np.ndarray, least: int
) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(class, shingles, places, which are in dense stretches) of the texts that have such; a class comes once."""
    fresh = []
    for name, _, shingles, place in sequences(block):
        if len(shingles) >= least and name not in seen:
            seen.add(name)
            fresh.append((name, shingles, place))
    if not fresh:
        return []
    lengths = [len(x) for _, x, _ in fresh]
    at = np.flatnonzero(may_hold(held, np.concatenate([x for _, x, _ in fresh])))
    text = np.repeat(np.arange(len(fresh)), lengths)[at]
    nth = ranges(np.zeros(len(fresh)), np.array(lengths))[at]
    at = at[dense(text, np.concatenate([x for *_, x in fresh])[at], nth, least)]
    kept = np.zeros(sum(lengths), dtype=bool)
    kept[at] = True
    marks = np.split(kept, np.cumsum(lengths)[:-1])
    return [(*row, mark) for row, mark in zip(fresh, marks) if mark.any()]


def _windows(least: int, held):
    """The windows that may hold a side of a passage, cut to their first and last shingle that may."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a class is cut once a task
        for batch in batches:
            for block in texts(column(batch, "text")):
                parts, places, names = [np.zeros(1, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)]
                marks = [np.zeros(1, dtype=bool)]
                for name, shingles, place, mark in _dense_sequences(block, seen, held.value, least):
                    parts += [np.maximum(shingles, np.uint64(1)), np.zeros(1, dtype=np.uint64)]
                    places += [place, np.zeros(1, dtype=np.int64)]
                    marks += [mark, np.zeros(1, dtype=bool)]
                    names.append(np.full(len(place) + 1, name, dtype=np.int64))
                flat, place, owner, mark = map(np.concatenate, (parts, places, names, marks))
                kept = np.flatnonzero(mark)
                count = np.concatenate([[0], np.cumsum(mark)])
                for f, seed in enumerate(_SEEDS):
                    hashes = np.where(flat > 0, mix(flat ^ seed) | np.uint64(1 << 3), np.uint64(0))
                    low, at, high = compact_windows(hashes, least)
                    some = may_hold(held.value, flat[at]) & (4 * (count[high + 1] - count[low]) >= 3 * least)
                    low, at, high = low[some], at[some], high[some]
                    low, high = place[kept[count[low]]], place[kept[count[high + 1] - 1]]
                    wide = high - low + 1 >= least
                    low, at, high = low[wide], at[wide], high[wide]
                    key = (hashes[at] & ~np.uint64(7)) | np.uint64(f)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(owner[at]), pa.array(signed(key))] + [pa.array(x.astype(np.int32)) for x in (low, high)],
                        ["c", "key", "low", "high"],
                    )

    return cut


def _meet(few: int):
    """Rows sorted by key and class -> all pairs of small groups, and the members of large ones (b is their key)."""
    kinds = [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.bool_()]
    names = ["a", "b", "f", "low_a", "high_a", "low_b", "high_b", "large"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), dtype=np.int64)  # rows of the group that the next batch may go on with
        going = False  # that group is large, and its held row has gone out
        for batch in chain(batches, [None]):
            rows = held
            if batch is not None:
                fresh = [np.asarray(column(batch, k), dtype=np.int64) for k in ("key", "c", "low", "high")]
                rows = np.concatenate([held, np.stack(fresh, axis=1)])
            if not len(rows):
                continue
            new = np.ones(len(rows), dtype=bool)  # a class may come from several tasks
            new[1:] = np.any(rows[1:, :2] != rows[:-1, :2], axis=1)
            rows = rows[new]
            opens = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            counts = np.diff(np.append(opens, len(rows)))
            size = np.repeat(counts, counts)
            if going:
                size[: counts[0]] = few + 1
            large = bool(size[-1] > few)
            done = len(rows) if batch is None or large else int(opens[-1])
            key, early, later = rows[:done, 0], [], []
            at = np.flatnonzero(size[:done] <= few)
            for lag in range(1, few):
                at = at[at >= lag]
                at = at[key[at] == key[at - lag]]
                if not len(at):
                    break
                early.append(at - lag)
                later.append(at)
            member = np.flatnonzero(size[:done] > few)
            if going:
                member = member[1:]
            a = rows[np.concatenate([*early, member]).astype(np.int64)]
            b = rows[np.concatenate([*later, member]).astype(np.int64)]
            is_member = np.arange(len(a)) >= len(a) - len(member)
            if len(a):
                other = np.where(is_member, a[:, 0], b[:, 1])
                values = [a[:, 1], other, a[:, 0] & 7, a[:, 2], a[:, 3], b[:, 2], b[:, 3], is_member]
                yield pa.RecordBatch.from_arrays([pa.array(v).cast(k) for v, k in zip(values, kinds)], names)
            held, going = (rows[-1:], True) if large else (rows[done:], False)

    return meet


def _fetched(least: int, held, wanted):
    """(c, shingles in dense stretches, their places and numbers) of the classes the filter lets through."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in texts(column(batch, "text")):
                names, shingles, places = [], [], []
                for name, found, place, kept in _dense_sequences(block, seen, held.value, least):
                    if may_hold(wanted.value, unsigned([name]))[0]:
                        names.append(name)
                        shingles.append(found[kept])
                        places.append(_steps(place[kept], np.flatnonzero(kept)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), packed(shingles), packed(places)], ["c", "shingles", "places"]
                )

    return fetch


def _steps(place: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Places and numbers as distances, which are nearly all one and so take no room once compressed."""
    return np.stack([np.diff(place, prepend=0), np.diff(nth, prepend=0)], axis=1).astype(np.int32)


def _slice(
    shingles: np.ndarray, steps: np.ndarray, low: int = 0, high: int = 1 << 62
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, places and numbers between two places."""
    place, nth = np.cumsum(steps, axis=0, dtype=np.int64).T
    x, y = np.searchsorted(place, [low, high + 1])
    return shingles[x:y], place[x:y], nth[x:y]


def _sequences_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(shingles, steps) of each row."""
    flat, cuts = unpacked(column(batch, "shingles"), "u8")
    steps = unpacked(column(batch, "places"), "i4")[0].reshape(-1, 2)
    return zip(np.split(flat, cuts[1:-1]), np.split(steps, cuts[1:-1])) if len(cuts) > 1 else iter(())


def _windows_of(batch: pa.RecordBatch) -> list[pa.Array]:
    """Columns of the shingles and steps within each row's window."""
    parts = [
        _slice(*own, low, high)
        for own, low, high in zip(_sequences_of(batch), *(column(batch, k).to_pylist() for k in ("from", "to")))
    ]
    return [packed([s for s, *_ in parts]), packed([_steps(*p) for _, *p in parts])]


def common_passages(
    left: np.ndarray, at_left: np.ndarray, right: np.ndarray, at_right: np.ndarray, least: int,
    nth_left: np.ndarray | None = None, nth_right: np.ndarray | None = None,
) -> list[tuple[int, int, int, int, int]]:
    """(start, stop, start, stop, shared): stretches of shared shingles that are similar enough.

    Places are words. Runs are parted where either side moves on by more than
    ``GAP`` or goes back. A part of a run is similar enough if both sides have ``least``
    places and the shared shingles are three quarters of all. Where the whole run is
    not, all its parts that are come out, overlapping ones as one. Sequences with
    shingles left out come with the number of each in its whole sequence.
    """
    _, i, j = np.intersect1d(left, right, assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    p, q = at_left[i].astype(np.int64), at_right[j].astype(np.int64)
    nth_p, nth_q = i if nth_left is None else nth_left[i], j if nth_right is None else nth_right[j]
    if not len(p):
        return []
    dp, dq = np.diff(p), np.diff(q)
    cuts = np.flatnonzero((np.maximum(dp, dq) > GAP) | (dq <= 0)) + 1
    out = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)]):
        if 4 * (b - a) < 3 * least or min(p[b - 1] - p[a], q[b - 1] - q[a]) + 1 < least:
            continue
        n_left, n_right = int(nth_p[b - 1] - nth_p[a]) + 1, int(nth_q[b - 1] - nth_q[a]) + 1
        parts = [(a, b)]
        if 4 * (b - a) < 3 * (n_left + n_right - (b - a)):
            within = _similar_parts(p[a:b], q[a:b], nth_p[a:b] + nth_q[a:b], least)
            ends = np.flatnonzero(np.diff(within.astype(np.int8), prepend=0, append=0)) + a
            parts = zip(ends[::2].tolist(), ends[1::2].tolist())
        out += [(int(p[x]), int(p[y - 1]) + WIDTH, int(q[x]), int(q[y - 1]) + WIDTH, y - x) for x, y in parts]
    return out


def _similar_parts(p: np.ndarray, q: np.ndarray, nth: np.ndarray, least: int) -> np.ndarray:
    """Which shared shingles of a run lie in a part of it that is similar enough; ``nth`` adds up both numbers.

    That is so from x to y if 7 * (y - x + 1) >= 3 * (left + right), or gain[y] + 1 >= gain[x].
    """
    n = len(p)
    gain = 7 * np.arange(n) - 3 * nth.astype(np.int64)
    # A part that ends at a shingle begins at this one or before; one that begins there ends at that one or behind.
    begin = np.minimum(*(np.searchsorted(x, x - least + 1, "right") - 1 for x in (p, q)))
    begin = np.minimum(begin, np.arange(n) + 1 + -3 * least // 4)
    end = np.searchsorted(begin, np.arange(n))
    best = np.append(np.maximum.accumulate(gain[::-1])[::-1], np.iinfo(np.int64).min // 2)
    count = np.concatenate([[0], np.cumsum(best[end] + 1 >= gain)])
    within = count[1:] > count[np.searchsorted(end, np.arange(n))]
    ends = np.flatnonzero(begin >= 0)
    within[ends] |= best[ends] + 1 >= np.minimum.accumulate(gain)[begin[ends]]
    return within


def _stretch_entries(
    ident: np.ndarray, member: np.ndarray, place: np.ndarray, side: np.ndarray | None, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """(entries, stretch of each) that a passage of two members may hold.

    A passage has shingles of both, next to each other up to ``GAP``, and its ends
    are ``least`` places apart. Without ``side`` any two members may share.
    """
    kept = np.arange(len(ident))
    for _ in range(8):  # each turn only thins out
        if side is None:
            held = np.bincount(ident[kept], minlength=len(ident)) > 1
        else:
            held = np.bincount(ident[kept], side[kept], len(ident)) > 0
            held &= np.bincount(ident[kept], ~side[kept], len(ident)) > 0
        some = kept[held[ident[kept]]]
        opens = np.ones(len(some), dtype=bool)
        opens[1:] = (member[some[1:]] != member[some[:-1]]) | (place[some[1:]] - place[some[:-1]] > GAP)
        first = np.flatnonzero(opens)
        count = np.diff(np.append(first, len(some)))
        span = place[some[first + count - 1]] - place[some[first]] + 1
        enough = (4 * count >= 3 * least) & (span >= least)
        stretch = np.repeat(np.cumsum(enough) - 1, count)
        some, stretch = some[np.repeat(enough, count)], stretch[np.repeat(enough, count)]
        settled = len(some) == len(kept)
        kept = some
        if settled:
            break
    return kept, stretch


class _Stretches:
    """The stretches of one tile: their shingles as bits, the passages found, and what these tie together."""

    def __init__(self, ident: np.ndarray, place: np.ndarray, index: np.ndarray, stretch: np.ndarray):
        cuts = np.flatnonzero(np.diff(stretch, prepend=-1)).tolist() + [len(stretch)]
        names, ident = np.unique(ident, return_inverse=True)
        self.n = len(cuts) - 1
        words = -(-len(names) // 64)
        self.exact = words * self.n <= BIT_WORDS
        self.words = words if self.exact else max(1, BIT_WORDS // self.n)
        self.ids = [ident[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        self.places = [place[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        self.index = [index[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        order = np.argsort(ident, kind="stable")  # by shingle: who holds it, as which of its window, where
        self.holders, self.holds, self.held_at, self.entry = stretch[order], index[order], place[order], order
        self.first = np.searchsorted(ident[order], np.arange(len(names) + 1))
        self.bits = np.zeros((self.n, self.words), dtype=np.uint64)
        for k, own in enumerate(self.ids):
            self._mark(self.bits[k], own)
        self.free = self.bits.copy()  # shingles outside the passages found
        self.found: list[list[tuple[int, int, int]]] = [[] for _ in range(self.n)]  # start, stop, node
        self.cuts = cuts
        self.top: list[int] = []
        self.tied = np.full(len(stretch), -1)  # what the passage that a shingle lies in is tied to
        self.label = np.full((SLOTS, self.n), -1)  # what the passages found are tied to
        self.inside = np.zeros((SLOTS, self.n, self.words), dtype=np.uint64)  # their shingles

    def _mark(self, row: np.ndarray, ids: np.ndarray) -> None:
        ids = ids % (self.words * 64)
        np.bitwise_or.at(row, ids >> 6, np.uint64(1) << (ids & 63).astype(np.uint64))

    def _find(self, node: int) -> int:
        while self.top[node] != node:
            self.top[node] = node = self.top[self.top[node]]
        return node

    def tie(self, a: int, b: int) -> None:
        a, b = self._find(a), self._find(b)
        if a != b:
            self.top[b] = a
            self.label[self.label == b] = a
            self.tied[self.tied == b] = a

    def add(self, k: int, start: int, stop: int) -> int:
        """Take in a passage of a stretch, joined with those up to ``SLACK`` apart; its node."""
        node, kept, known = len(self.top), [], False
        for low, high, other in self.found[k]:
            if low <= start and stop <= high:
                return other
        self.top.append(node)
        for low, high, other in self.found[k]:
            if low <= stop + SLACK and start <= high + SLACK:
                start, stop = min(low, start), max(high, stop)
                self.tie(other, node)
            else:
                kept.append((low, high, other))
        self.found[k] = [*kept, (start, stop, node)]
        at = self.places[k]
        free = np.ones(len(at), dtype=bool)
        self.label[:, k], self.inside[:, k], self.free[k] = -1, 0, 0
        for slot, (low, high, other) in enumerate(reversed(self.found[k])):
            own = (at >= low) & (at <= high - WIDTH)
            self.tied[self.cuts[k] : self.cuts[k + 1]][own] = self._find(other)
            if slot < SLOTS:
                free &= ~own
                self.label[slot, k] = self._find(other)
                self._mark(self.inside[slot, k], self.ids[k][own])
        self._mark(self.free[k], self.ids[k][free])
        return node

    def alike(self, k: int, others: np.ndarray, least: int) -> np.ndarray:
        """Those of the others that share enough shingles for a passage, the most alike first."""
        both = np.bitwise_count(self.bits[others] & self.bits[k]).sum(axis=1, dtype=np.int64)
        some = 4 * both >= 3 * least if self.exact else both > 0
        return others[some][np.argsort(-both[some], kind="stable")]

    def fitting(self, k: int, others: np.ndarray, least: int) -> np.ndarray:
        """Those of the others that may have a passage with this stretch that adds a place or a tie.

        Three quarters of all are shared if 7 * shared >= 3 * (left + right), both counted
        between the first and the last shared shingle. One of them at least is in no
        passage of both that are tied together.
        """
        own, lag, n = self.ids[k], -(-3 * least // 4) - 1, len(self.ids[k])
        # A passage that ends at a column begins at this one or before; one that begins there ends at that one or behind.
        begin = np.searchsorted(self.places[k], self.places[k] - least + 1, "right") - 1
        begin = np.minimum(begin, np.arange(n) - lag)
        end = np.searchsorted(begin, np.arange(n))
        counts = self.first[own + 1] - self.first[own]
        at = ranges(self.first[own], counts)
        row, col = np.full(self.n, -1), np.repeat(np.arange(n), counts)
        row[others] = np.arange(len(others))
        row = row[self.holders[at]]
        at, row, col = at[row >= 0], row[row >= 0], col[row >= 0]
        shape = (len(others), n)
        shared, adds = np.zeros(shape, dtype=np.int32), np.zeros(shape, dtype=bool)
        shared[row, col] = 1
        mine, other = self.tied[self.cuts[k] : self.cuts[k + 1]][col], self.tied[self.entry[at]]
        adds[row, col] = (mine < 0) | (mine != other)
        gain = np.cumsum(shared, axis=1, dtype=np.int32)[row, col] * 7 - 3 * (self.index[k][col] + self.holds[at])
        far = 1 << 30
        low, high = np.full(shape, far, dtype=np.int64), np.full((len(others), n + 1), -far, dtype=np.int64)
        low[row, col] = high[row, col] = gain
        high = np.maximum.accumulate(high[:, ::-1], axis=1)[:, ::-1]  # of all columns from here on
        begins = np.zeros((len(others), n + 1), dtype=np.int32)
        np.cumsum(high[:, end] - low >= -1, axis=1, out=begins[:, 1:])
        within = begins[:, 1:] > begins[:, np.searchsorted(end, np.arange(n))]
        ends = np.flatnonzero(begin >= 0)
        within[:, ends] |= high[:, ends] - np.minimum.accumulate(low, axis=1)[:, begin[ends]] >= -1
        first, last = np.full(len(others), far, dtype=np.int64), np.full(len(others), -far, dtype=np.int64)
        np.minimum.at(first, row, self.held_at[at])
        np.maximum.at(last, row, self.held_at[at])
        return others[np.any(within & adds, axis=1) & (last - first + 1 >= least)]

    def open(self, k: int, others: np.ndarray) -> np.ndarray:
        """Which others may yet add a place or a tie."""
        out = np.any(self.free[k] & self.bits[others], axis=1)
        rest = np.flatnonzero(~out)
        out[rest] = np.any(self.free[others[rest]] & self.bits[k], axis=1)
        for mine in np.flatnonzero(self.label[:, k] >= 0).tolist():
            for slot in range(SLOTS):  # shingles in passages of both that are not tied together
                rest = np.flatnonzero(~out & (self.label[slot, others] >= 0) & (self.label[slot, others] != self.label[mine, k]))
                if len(rest):
                    out[rest] = np.any(self.inside[slot, others[rest]] & self.inside[mine, k], axis=1)
        return out


def group_passages(
    sets: list[np.ndarray], places: list[np.ndarray], block: np.ndarray, least: int,
    numbers: list[np.ndarray] | None = None,
) -> list[tuple[int, int, int, int, int, int, int]]:
    """(member, member, start, stop, start, stop, shared) of the windows of one tile.

    Members of two blocks are compared across, those of one with each other. Passages
    that lie within found ones of both members, tied together already, may be left out.
    Windows with shingles left out come with the numbers of the others.
    """
    numbers = numbers or [np.arange(len(x)) for x in sets]
    lengths = list(map(len, sets))
    member = np.repeat(np.arange(len(sets)), lengths)
    ident = np.unique(np.concatenate(sets), return_inverse=True)[1]
    place = np.concatenate(places).astype(np.int64)
    across = bool(np.any(block != block[0]))
    side = (block != block[0])[member] if across else None
    kept, stretch = _stretch_entries(ident, member, place, side, least)
    if not len(kept):
        return []
    index = np.concatenate(numbers)
    all_of = _Stretches(ident[kept], place[kept], index[kept], stretch)
    first = np.flatnonzero(np.diff(stretch, prepend=-1))
    owner, begin = member[kept][first], place[kept][first]
    cuts = np.searchsorted(owner, np.arange(len(sets) + 1)).tolist()

    def holder(m: int, start: int) -> int:
        """The stretch of a member that a passage from there lies in."""
        return cuts[m] + int(np.searchsorted(begin[cuts[m] : cuts[m + 1]], start, "right")) - 1

    out: list[tuple[int, int, int, int, int, int, int]] = []
    compared: set[tuple[int, int]] = set()
    for x in range(all_of.n):
        others = np.arange(x + 1, all_of.n)
        theirs = block[owner[others]] != block[owner[x]] if across else owner[others] != owner[x]
        others, step = all_of.alike(x, others[theirs], least), 1
        while len(others):
            others = others[all_of.open(x, others)]  # what adds nothing now never will
            if step >= MANY:
                size = max(1, min(AT_ONCE, CELLS // len(all_of.ids[x])))
                others = np.concatenate([
                    all_of.fitting(x, others[a : a + size], least) for a in range(0, len(others) or 1, size)
                ])
            for y in others[:step].tolist():
                a, b = int(owner[x]), int(owner[y])
                if (a, b) in compared or not all_of.open(x, np.array([y]))[0]:
                    continue
                compared.add((a, b))
                for run in common_passages(sets[a], places[a], sets[b], places[b], least, numbers[a], numbers[b]):
                    mine, other = holder(a, run[0]), holder(b, run[2])
                    all_of.tie(all_of.add(mine, *run[:2]), all_of.add(other, *run[2:4]))
                    out.append((a, b, *run))
            others, step = others[step:], step * 2
    return out


_TILE = ["key", "low", "high"]


def _members_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the slices out of their texts' sequences."""
    kept = ["key", "low", "high", "c", "block"]
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [column(batch, k) for k in kept] + _windows_of(batch), [*kept, "shingles", "places"]
        )


def _tiles(least: int):
    """Rows sorted by tile -> passages."""

    def emit(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        name, block = (np.asarray(rows[k].combine_chunks(), dtype=np.int64) for k in ("c", "block"))
        own = [_slice(*x) for x in _sequences_of(rows.combine_chunks().to_batches()[0])]
        found = []
        if rows["low"][0] == rows["high"][0] or len(np.unique(block)) > 1:
            found = group_passages([x for x, *_ in own], [x for _, x, _ in own], block, least, [x for *_, x in own])
        found = np.array(found, dtype=np.int64).reshape(-1, 7).T
        return pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (name[found[0]], name[found[1]], *found[2:])],
            ["a", "b", "start_a", "stop_a", "start_b", "stop_b", "shared"],
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
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
                    yield emit(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
        if held:
            yield emit(held)

    return compare


def word_runs(block: Texts, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, hash, smallest shingle) of every run of ``words`` words, in order.

    No run reaches over the end of its text. Runs of one word over and over are left out.
    """
    starts, lengths = block.lower().spans(VISIBLE)
    bounds = block.per_text(starts)
    hashes = span_hash(block.data, starts, lengths)
    whole = mix(chained(hashes, WIDTH) ^ _SEEDS[0])
    low, least, step = whole, words - WIDTH + 1, 1
    counts = np.maximum(np.diff(bounds) - words + 1, 0)
    at = ranges(bounds[:-1], counts)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64)
    while step < least:
        shift = min(step, least - step)  # the last two halves may overlap
        whole = mix(whole[:-shift] * _SEEDS[1] ^ whole[shift:])
        low = np.minimum(low[:-shift], low[shift:])
        step += shift
    changes = np.concatenate([[0], np.cumsum(hashes[1:] != hashes[:-1])])
    at = at[changes[at + words - 1] > changes[at]]
    text = np.searchsorted(bounds, at, "right") - 1
    return text, at - bounds[text], whole[at], mix(low[at])


def _class_names(block: Texts) -> np.ndarray:
    data = block.used
    return np.array([
        xxhash.xxh64_intdigest(data[a:b].tobytes()) - 2**63
        for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist())
    ], dtype=np.int64)


def _stretches(text: np.ndarray, start: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Where neighbouring runs of one text with one smallest shingle begin."""
    opens = np.ones(len(text), dtype=bool)
    opens[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1) | (node[1:] != node[:-1])
    return np.flatnonzero(opens)


def _nodes(words: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in texts(column(batch, "text")):
                names = _class_names(block)
                text, start, _, node = word_runs(block, words)
                first = _stretches(text, start, node)
                fresh = np.zeros(len(names), dtype=bool)
                for k, name in enumerate(names.tolist()):
                    if name not in seen:
                        seen.add(name)
                        fresh[k] = True
                first = first[fresh[text[first]]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[text[first]]), pa.array(signed(node[first]))], ["c", "node"]
                )

    return cut


def _keyed_runs(words: int, known, hot):
    """Rows of neighbouring runs that other texts may hold, by smallest shingle or, if hot, by run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}  # a class goes out again only with a smaller id
        for batch in batches:
            ids = np.asarray(column(batch, "doc_id").fill_null(_NO_ID), dtype=np.int64)
            for block in texts(column(batch, "text")):
                names = _class_names(block)
                own = ids[block.first : block.first + len(block)]
                fresh = np.zeros(len(names), dtype=bool)
                for k, (name, key) in enumerate(zip(names.tolist(), own.tolist())):
                    if name not in seen or key < seen[name]:
                        seen[name] = key
                        fresh[k] = True
                text, start, run, node = word_runs(block, words)
                kept = fresh[text]
                kept[kept] = may_hold(known.value, node[kept])
                text, start, run, node = text[kept], start[kept], run[kept], node[kept]
                first = _stretches(text, start, node)
                often = may_hold(hot.value, node)
                node = np.where(often, run, node)
                opens = often.copy()
                opens[first] = True
                first = np.flatnonzero(opens)
                cuts = np.append(first, len(run)).astype(np.int64) * 8
                flat = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(run))]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(node[first])), pa.array(own[text[first]]), pa.array(names[text[first]]),
                     pa.array(start[first].astype(np.int32)), flat.cast(pa.binary())],
                    ["key", "id", "c", "start", "runs"],
                )

    return cut


def _held_twice(words: int):
    """Rows sorted by key, id and class -> stretches whose runs another class holds too.

    The first class of a run has the smallest id that any holder has. Its places
    wait with the key until another class comes.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = np.zeros((0, 5), dtype=np.int64)  # key, id, class, start, run
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, cuts = unpacked(column(batch, "runs"), "i8")
            n = np.diff(cuts)
            row = np.repeat(np.arange(len(n)), n)
            fields = [np.asarray(column(batch, k), dtype=np.int64)[row] for k in ("key", "id", "c", "start")]
            fields[3] = fields[3] + np.arange(len(runs)) - cuts[:-1][row]
            each = np.concatenate([waiting, np.stack([*fields, runs], axis=1)])
            row = np.concatenate([np.full(len(waiting), -1), row])
            order = np.lexsort((each[:, 4], each[:, 0]))  # stable: ids stay in order
            by_run = each[order]
            opens = np.ones(len(by_run), dtype=bool)
            opens[1:] = (by_run[1:, 0] != by_run[:-1, 0]) | (by_run[1:, 4] != by_run[:-1, 4])
            group = np.cumsum(opens) - 1
            head = np.flatnonzero(opens)[group]
            foreign = by_run[:, 2] != by_run[head, 2]
            shared = np.zeros(len(by_run), dtype=bool)
            shared[order] = np.bincount(group, foreign)[group] > 0
            other = np.zeros(len(by_run), dtype=np.int64)
            other[order] = by_run[head, 1]
            wait = np.zeros(len(by_run), dtype=bool)
            wait[order] = ~foreign
            out, row, other = each[shared], row[shared], other[shared]
            waiting = each[wait & (each[:, 0] == each[-1, 0])]
            if len(out):
                opens = np.ones(len(out), dtype=bool)
                opens[1:] = (
                    (row[1:] != row[:-1]) | (out[1:, 2] != out[:-1, 2])
                    | (out[1:, 3] != out[:-1, 3] + 1) | (other[1:] != other[:-1])
                )
                first = np.flatnonzero(opens)
                last = np.append(first[1:], len(out)) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (out[first, 2], out[first, 3], out[last, 3] + words, other[first])],
                    ["c", "start", "stop", "other_id"],
                )

    return meet


def _row_names(names: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(names.view(np.uint64) ^ mix(ids.view(np.uint64) ^ _SEEDS[2]))


def _first_rows(classes: DataFrame) -> np.ndarray:
    """A filter that knows the row of each class (c, first_id) with the smallest id."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.asarray(column(batch, "c"), dtype=np.int64)
            ids = np.asarray(column(batch, "first_id").fill_null(_NO_ID), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(_row_names(names, ids)))], ["name"])

    return bit_filter(classes.select("c", "first_id").mapInArrow(name, "name long"), "name", FIRST_BITS)


def _kept_rows(batches: Iterator[pa.RecordBatch], firsts) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = np.asarray(column(batch, "doc_id").fill_null(_NO_ID), dtype=np.int64)
        kept = np.zeros(batch.num_rows, dtype=bool)
        for block in texts(column(batch, "text")):
            own = slice(block.first, block.first + len(block))
            kept[own] = may_hold(firsts.value, _row_names(_class_names(block), ids[own]))
        yield batch if kept.all() else batch.filter(pa.array(kept))


def _each_class(docs: DataFrame, firsts, work, schema: str) -> DataFrame:
    """``work`` on the rows of docs that ``firsts`` knows: equal texts in many tasks go on from one."""

    return docs.select("doc_id", "text").mapInArrow(lambda batches: work(_kept_rows(batches, firsts)), schema)


def equal_passages(docs: DataFrame, firsts, least_words: int = LEAST_WORDS) -> DataFrame:
    """(c, start, stop, other_id): all stretches whose runs of ``least_words`` words another class holds.

    ``other_id`` is the smallest id of all texts that hold them.
    """
    context = docs.sparkSession.sparkContext
    nodes = _each_class(docs, firsts, _nodes(least_words), "c long, node long")
    held = nodes.groupBy("node").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"))
    held = settle(held.where("low <> high").select("node", "n"))
    known = context.broadcast(bit_filter(held, "node", RUN_BITS))
    hot = context.broadcast(bit_filter(held.where(F.col("n") > HOT), "node", FILTER_BITS))
    rows = _each_class(
        docs, firsts, _keyed_runs(least_words, known, hot), "key long, id long, c long, start int, runs binary"
    )
    rows = rows.repartition("key").sortWithinPartitions("key", "id", "c")
    found = rows.mapInArrow(_held_twice(least_words), "c long, start long, stop long, other_id long")
    return found.withColumn("other_id", F.expr(f"nullif(other_id, {_NO_ID}L)"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = column(batch, "doc_id")
        for block in texts(column(batch, "text")):
            counts = np.diff(block.per_text(block.spans(VISIBLE)[0]))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(block.first, len(block)), pa.array(_class_names(block)), pa.array(counts.astype(np.int64))],
                ["doc_id", "c", "n_words"],
            )


def held_bits(words: int) -> int:
    """Bits of the filter of shared shingles, from the words of all classes."""
    return min(max(HELD_BITS, int(words).bit_length()), MOST_HELD_BITS)


def passages(docs: DataFrame, firsts, words: int, least_words: int = LEAST_WORDS) -> DataFrame:
    """Verified passages between classes of equal texts: a, b (names), their words, shared shingles.

    ``firsts`` knows a row of each class, ``words`` are those of all classes.
    """
    context = docs.sparkSession.sparkContext
    least = least_words - WIDTH + 1
    held = context.broadcast(twice_filter(docs.select("doc_id", "text"), _all_shingles(least, firsts), held_bits(words)))
    rows = _each_class(docs, firsts, _windows(least, held), "c long, key long, low int, high int")
    grouped = rows.repartition("key").sortWithinPartitions("key", "c")
    members = grouped.mapInArrow(_meet(1), _MET).select(
        F.col("a").alias("c"), F.col("b").alias("key"), F.col("low_a").alias("from"), F.col("high_a").alias("to")
    )
    members = settle(_joined(settle(members)))
    known = context.broadcast(bit_filter(members.select("c").distinct(), "c", FILTER_BITS))
    sequence = _each_class(docs, firsts, _fetched(least, held, known), "c long, shingles binary, places binary")
    sequence = sequence.repartition("c").dropDuplicates(["c"])
    return _compared(members, sequence, least)


def _joined(members: DataFrame) -> DataFrame:
    """Members (c, key, from, to) of the groups, once those with one smallest member are one."""
    hubs = members.groupBy("key").agg(F.min("c").alias("hub"))
    return members.join(hubs, "key").groupBy(F.col("hub").alias("key"), "c").agg(
        F.min("from").alias("from"), F.max("to").alias("to")
    )


def _compared(members: DataFrame, sequence: DataFrame, least: int) -> DataFrame:
    """Passages of the slices (c, key, from, to) of groups, block against block."""
    blocks = members.groupBy("key").agg(
        F.ceil(F.sum(F.col("to") - F.col("from") + 1) / BLOCK).cast("int").alias("blocks")
    )
    rows = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "c", "block", "from", "to",
    )
    rows = rows.join(sequence, "c").mapInArrow(
        _members_cut, "key long, low int, high int, c long, block int, shingles binary, places binary"
    )
    tiles = rows.repartition(*_TILE).sortWithinPartitions(*_TILE)
    return tiles.mapInArrow(_tiles(least), _PASSAGE)


def _with_passage(each: DataFrame, slack: int = 0) -> DataFrame:
    """Add to rows with c, start and stop where the passage begins that they overlap to, or come near to."""
    by_start = Window.partitionBy("c").orderBy("start", "stop")
    reached = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.coalesce(reached + slack, F.lit(-1)) < F.col("start"), F.col("start"))
    return each.withColumn("opens", opens).withColumn(
        "passage", F.max("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("opens")


def similar_passages(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, start, stop, other_id) of verified pairs; the id is the smallest of all passages they tie together."""
    ends = found.select(
        F.xxhash64("a", "start_a", "stop_a", "b", "start_b", "stop_b").alias("pair"),
        F.explode(F.array(*[
            F.struct(F.col(k).alias("c"), F.col(f"start_{k}").alias("start"), F.col(f"stop_{k}").alias("stop"))
            for k in "ab"
        ])).alias("end"),
    ).select("pair", "end.*")
    ends = settle(_with_passage(ends, SLACK).withColumn("node", F.xxhash64("c", "passage")))
    links = ends.groupBy("pair").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("a", "b").distinct()
    label = components(links)
    each = ends.groupBy("c", "node").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    each = each.join(label, "node").join(classes.select("c", "first_id"), "c")
    lowest = each.groupBy("label").agg(F.min("first_id").alias("other_id"))
    return each.join(lowest, "label").select("c", "start", "stop", "other_id")


def shared_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, start, stop, n_words, other_id: each document's passages that others hold too.

    Places count words (``[^\\x20\\x09-\\x0D]+``), the end is exclusive. Overlapping
    passages of a document are one, as are changed ones up to ``SLACK`` words apart. ``other_id`` is the smallest id of all texts that
    share it, the document among them; changed passages share where verified pairs
    tie them together. Rows with equal texts share the whole text if it is long enough.
    Documents without such passages have no row; neither have null or short texts.
    Rows of one id are told apart by their text, equal ones each have their row;
    other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    members = settle(docs.mapInArrow(_members, "doc_id long, c long, n_words long"))
    classes = members.groupBy("c").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("n_docs"), F.first("n_words").alias("n_words")
    )
    words = classes.agg(F.sum("n_words")).first()[0] or 0
    firsts = docs.sparkSession.sparkContext.broadcast(_first_rows(classes))
    found = settle(passages(docs, firsts, words, least_words))
    each = similar_passages(found, classes)
    each = each.unionByName(equal_passages(docs, firsts, least_words))
    whole = classes.where((F.col("n_docs") > 1) & (F.col("n_words") >= least_words)).select(
        "c", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop"), F.col("first_id").alias("other_id")
    )
    each = each.unionByName(whole).groupBy("c", "start", "stop").agg(F.min("other_id").alias("other_id"))
    merged = (
        _with_passage(each)
        .groupBy("c", "passage")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("other_id").alias("other_id"))
    )
    return members.drop("n_words").join(merged.drop("passage"), "c").select(
        "doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), "other_id"
    )


@query("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_passages(load(spark, sf_dir, "documents"))
