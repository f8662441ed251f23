"""Token ids of whole texts by the tokenizers library, coding each distinct unit once.

Random words make a BPE library spend its time on merges, yet most units of a
corpus have been seen before. The word-BPE tokenizer works on units that never
reach over white space: a run of letters, one digit, or a run of other signs.
Units are found on the bytes, looked up by hash in a bounded table, and only
unknown ones go to the library.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tabforge.llm.tokens import VISIBLE, Texts, ranges, runs, span_hash

SPACE, LETTER, DIGIT, SIGN, ODD = 0, 1, 2, 3, 4
_HIGHEST = 0x250


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte below 0x80, and of each code point below ``_HIGHEST``.

    Apostrophes (contractions), ``<`` (special tokens), control codes, no-break
    spaces and whatever lies above Latin Extended-B are ODD: the library gets the
    whole run between white space then.
    """
    points = np.full(_HIGHEST, ODD, dtype=np.uint8)
    for code in range(0x21, _HIGHEST):
        kind = unicodedata.category(chr(code))
        if kind[0] == "L":
            points[code] = LETTER
        elif kind[0] == "N":
            points[code] = DIGIT
        elif kind[0] in "PS":
            points[code] = SIGN
    points[[ord("'"), ord("<"), 0x130]] = ODD
    single = points[:0x100].copy()
    single[0x80:] = ODD
    single[~VISIBLE] = SPACE
    return single, points


_SINGLE, _POINTS = _classes()


def units(block: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the units of a block."""
    data = block.used
    kind = _SINGLE[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
    if len(lead):
        tail = block.data[lead + 1]
        code = ((data[lead].astype(np.int64) & 0x1F) << 6) | (tail & 0x3F)
        found = _POINTS[np.minimum(code, _HIGHEST - 1)]
        found[code >= _HIGHEST] = ODD
        kind[lead] = found
        kind[np.minimum(lead + 1, len(kind) - 1)] = found
    starts, lengths = runs(kind != SPACE, block.bounds)
    odd = np.concatenate([[0], np.cumsum(kind == ODD)])
    whole = odd[starts + lengths] > odd[starts]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    continues = (data & 0xC0) == 0x80
    cut[:-1] |= (kind == DIGIT) & ~continues
    for a, n in zip(starts[whole], lengths[whole]):
        cut[a : a + n] = False
    cut[starts] = True
    cut[:-1] &= kind != SPACE
    cut[-1] = False
    opens = np.flatnonzero(cut)
    ends = starts + lengths
    run = np.searchsorted(starts, opens, side="right") - 1
    following = np.append(opens[1:], len(data))
    return opens, np.minimum(following, ends[run]) - opens


class Coder:
    """Ids of texts, with a table of known units that never outgrows ``slots``."""

    def __init__(self, path: str, slots: int = 1 << 20, kept_ids: int = 1 << 23):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.slots, self.kept_ids = slots, kept_ids
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(self.slots, dtype=np.uint64)
        self.place = np.zeros(self.slots, dtype=np.int64)
        self.count = np.zeros(self.slots, dtype=np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def _learn(self, block: Texts, starts, lengths, hashes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of unknown units from the library; later units may take the place of earlier ones."""
        raw = block.data
        coded = self.library.encode_batch_fast(
            [raw[a : a + n].tobytes().decode() for a, n in zip(starts.tolist(), lengths.tolist())],
            add_special_tokens=False,
        )
        parts = [c.ids for c in coded]
        counts = np.fromiter(map(len, parts), dtype=np.int32, count=len(parts))
        flat = np.fromiter((i for p in parts for i in p), dtype=np.uint32, count=int(counts.sum()))
        if self.used + len(flat) > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.used + len(flat)), dtype=np.uint32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(flat)] = flat
        places = self.used + np.cumsum(counts) - counts
        self.used += len(flat)
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        self.keys[slot], self.place[slot], self.count[slot] = hashes, places, counts
        return places, counts

    def code(self, block: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and where the ids of each text begin (one entry more)."""
        starts, lengths = units(block)
        hashes = span_hash(block.data, starts, lengths)
        if self.used > self.kept_ids:
            self._clear()
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        place, count = self.place[slot], self.count[slot].astype(np.int64)
        missing = np.flatnonzero((self.keys[slot] != hashes) | (hashes == 0))
        if len(missing):
            known, first, back = np.unique(
                hashes[missing], return_index=True, return_inverse=True
            )
            pick = missing[first]
            places, counts = self._learn(block, starts[pick], lengths[pick], known)
            place[missing], count[missing] = places[back], counts[back]
        ids = self.ids[ranges(place, count)]
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids, ends[np.searchsorted(starts, block.bounds)]


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One coder per worker and tokenizer file, so that tasks share what is known."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
