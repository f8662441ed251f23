"""Simple-8b: a selector and as many equally wide ids as fit, in each 64-bit word.

Ids are cut into lanes of ``LANE`` ids. All lanes of a call are coded side by
side, and the word offset of each lane lets a reader start anywhere.
"""

from __future__ import annotations

import numpy as np

LANE = 1024

# Ids per word and bits per id of each selector. Selector 0 is the
# escape: the next word holds one id of more than 60 bits as it is.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 120])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])

_BY_COUNT = [int(s) for s in np.argsort(COUNTS[1:], kind="stable") + 1]
_SELECTOR_SHIFT = np.uint64(60)


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    high = (ids >> np.uint64(32)).astype(np.float64)
    low = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    wide = np.frexp(high)[1] + 32
    return np.where(high > 0, wide, np.frexp(low)[1]).astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the word at which each lane starts (one entry more than lanes)."""
    ids = np.asarray(ids, dtype=np.uint64)
    lanes = -(-len(ids) // LANE)
    if not lanes:
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    reach = int(COUNTS.max())
    grid = np.zeros((lanes, LANE + reach), dtype=np.uint64)
    padded = np.zeros(lanes * LANE, dtype=np.uint64)
    padded[: len(ids)] = ids
    grid[:, :LANE] = padded.reshape(lanes, LANE)
    bits = bit_lengths(grid)

    # The selector that takes most ids from each place on; fewer ids come first, so
    # a longer one that fits replaces them.
    best = np.zeros((lanes, LANE), dtype=np.uint8)
    smallest = int(bits[:, :LANE].min())
    for s in _BY_COUNT:
        n, width = int(COUNTS[s]), int(WIDTHS[s])
        if smallest > width and len(ids) == lanes * LANE and n <= LANE // 4 and width:
            continue
        wide = np.zeros((lanes, LANE + reach + 1), dtype=np.int16)
        np.cumsum(bits > width, axis=1, dtype=np.int16, out=wide[:, 1:])
        fits = wide[:, n : n + LANE] == wide[:, :LANE]
        best[fits] = s
    step = COUNTS[best]

    opens = np.zeros((lanes, LANE), dtype=bool)
    lengths = np.full(lanes, LANE)
    lengths[-1] = len(ids) - (lanes - 1) * LANE
    lane, place = np.arange(lanes), np.zeros(lanes, dtype=np.int64)
    while len(lane):
        opens[lane, place] = True
        place = place + step[lane, place]
        on = place < lengths[lane]
        lane, place = lane[on], place[on]

    rows, cols = np.nonzero(opens)
    selector = best[rows, cols]
    escapes = selector == 0
    words_each = 1 + escapes
    at = np.cumsum(words_each) - words_each
    words = np.zeros(int(words_each.sum()), dtype=np.uint64)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        if s == 0:
            words[at[mine] + 1] = grid[rows[mine], cols[mine]]
            continue
        word = np.full(len(mine), np.uint64(s) << _SELECTOR_SHIFT, dtype=np.uint64)
        if WIDTHS[s]:
            for k in range(int(COUNTS[s])):
                word |= grid[rows[mine], cols[mine] + k] << np.uint64(k * int(WIDTHS[s]))
        words[at[mine]] = word
    per_lane = np.bincount(rows, weights=words_each, minlength=lanes).astype(np.int64)
    return words, np.concatenate([[0], np.cumsum(per_lane)])


def decode(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids back, all words of a selector at once."""
    out = np.zeros(n_ids, dtype=np.uint64)
    if not n_ids:
        return out
    lanes = len(offsets) - 1
    selector = (words >> _SELECTOR_SHIFT).astype(np.int64)
    raw = _raw_words(selector)
    counts = np.where(raw, 0, COUNTS[selector])
    lane_of = np.repeat(np.arange(lanes), np.diff(offsets))
    before = np.cumsum(counts) - counts
    place = before - before[offsets[:-1]][lane_of]  # ids of the lane before this word
    if len(place) != len(words) or np.any(place[~raw] >= LANE):
        raise ValueError("lane offsets do not match the words")
    limit = np.minimum(LANE, n_ids - lane_of * LANE)
    for s in np.unique(selector[~raw]):
        mine = np.flatnonzero((selector == s) & ~raw)
        if s == 0:
            out[lane_of[mine] * LANE + place[mine]] = words[mine + 1]
            continue
        width = int(WIDTHS[s])
        if not width:
            continue
        mask = np.uint64((1 << width) - 1)
        for k in range(int(COUNTS[s])):
            held = mine[place[mine] + k < limit[mine]]
            out[lane_of[held] * LANE + place[held] + k] = (words[held] >> np.uint64(k * width)) & mask
    return out


def _raw_words(selector: np.ndarray) -> np.ndarray:
    """Which words are raw ids: those right behind an escape that is not raw itself."""
    raw = np.zeros(len(selector), dtype=bool)
    zero = np.flatnonzero(selector == 0)
    k = 0
    while k < len(zero):  # escapes are rare: ids above 60 bits
        follower = zero[k] + 1
        if follower >= len(selector):
            raise ValueError("an escape without its id")
        raw[follower] = True
        k += 2 if k + 1 < len(zero) and zero[k + 1] == follower else 1
    return raw
