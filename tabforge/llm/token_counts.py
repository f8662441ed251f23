"""Token counts that follow edits: a segment tree of pre-tokens per document.

A byte-level BPE tokenizer first cuts a text into pre-tokens by a pattern and then
codes each alone, so a document's count is the sum over its pre-tokens. The tree
keeps these sums. An edit can only change pre-tokens near it: cutting starts again
at the pre-token that reaches within ``CONTEXT`` signs of the edit and stops where
a new cut falls on an old one behind the edit, with ``CONTEXT`` signs to spare. Only
that stretch is coded anew; its first leaf takes the new sum, its other leaves zero,
and only their ancestors are updated.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabforge.llm.registry import query
from tabforge.llm.tokens import texts
from tabforge.llm.vocab import column
from tabforge.sources.tables import load

TOKENIZER = "byte_bpe_50k.json"
#: The pattern looks this far beyond a cut at most ("'re", and one sign behind white space).
CONTEXT = 3
KNOWN = 400_000
# Fixed value: the pre-token pattern of this kind of tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: (pattern, replacement) of the edits that the query applies.
RULES = [
    (r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+", "<email>"),
    (r"\+[0-9][ ().0-9-]{7,20}[0-9]", "<phone>"),
    (r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])", "<ip>"),
    (r"(?<![0-9])[0-9]{14,19}(?![0-9])", "<card>"),
    (r"token = \"[0-9a-fA-F]+\"", ""),
    (r"Licensed under the [^.\n]{1,60}, Version [0-9.]+\.?", ""),
]

_SCHEMA = "doc_id long, n_tokens long, n_edits long, n_recoded long, n_tokens_after long"


class Counter:
    """Tokens of single pre-tokens; what was coded is kept, up to ``KNOWN`` of them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings are ordinary text
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        return self.cut.findall(text)

    def counts(self, pieces: Sequence[str]) -> list[int]:
        known = self.known
        missing = [p for p in set(pieces) if p not in known]
        if missing:
            if len(known) > KNOWN:
                known.clear()
                missing = list(set(pieces))
            coded = self.library.encode_batch_fast(missing, add_special_tokens=False)
            known.update(zip(missing, (len(c.ids) for c in coded)))
        return [known[p] for p in pieces]


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


class TokenTree:
    """Token sums over the pre-tokens of one text."""

    def __init__(self, text: str, counts: Counter, pieces: list[str] | None = None):
        self.text, self.counts = text, counts
        pieces = counts.pieces(text) if pieces is None else pieces
        self.ends = np.fromiter(accumulate(map(len, pieces)), dtype=np.int64, count=len(pieces))
        size = 1 << (max(1, len(pieces)) - 1).bit_length()
        self.sums = np.zeros(2 * size, dtype=np.int64)
        self.sums[size : size + len(pieces)] = counts.counts(pieces)
        while size > 1:
            half = size // 2
            self.sums[half:size] = self.sums[size : 2 * size].reshape(-1, 2).sum(axis=1)
            size = half
        self.recoded = 0

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def _assign(self, first: int, last: int, value: int) -> None:
        """Leaf ``first`` gets the value, the others up to ``last`` zero; then their ancestors."""
        size = len(self.sums) // 2
        low, high = size + first, size + last
        self.sums[low : high + 1] = 0
        self.sums[low] = value
        while low > 1:
            low, high = low // 2, high // 2
            self.sums[low : high + 1] = self.sums[2 * low : 2 * high + 2].reshape(-1, 2).sum(axis=1)

    def edit(self, edits: Sequence[tuple[int, int, str]]) -> None:
        """Replace [start, stop) by the given text; edits are in order and do not overlap.

        All places are those of the text the tree was made of; edit it once.
        """
        k, n = 0, len(self.ends)
        while k < len(edits) and n:
            first = int(np.searchsorted(self.ends, edits[k][0] - CONTEXT))
            first = min(first, n - 1)
            begin = int(self.ends[first - 1]) if first else 0
            fresh, at = "", begin  # new text so far, and the old place it reaches
            ahead = 8
            while True:
                # Take in edits that start before the place where the old text is left off.
                last = min(n - 1, int(np.searchsorted(self.ends, max(at, edits[k][1] if k < len(edits) else 0), "left")) + ahead)
                stop = int(self.ends[last])
                while k < len(edits) and edits[k][0] <= stop + CONTEXT:
                    start, end, new = edits[k]
                    fresh += self.text[at:start] + new
                    at = end
                    k += 1
                    last = min(n - 1, int(np.searchsorted(self.ends, at, "left")) + ahead)
                    stop = int(self.ends[last])
                behind = self.text[at:stop]
                found = self._resync(fresh, behind, at, stop)
                if found is not None:
                    break
                ahead *= 2
            pieces, until = found
            leaf = int(np.searchsorted(self.ends, until, "left"))
            self._assign(first, max(first, leaf), sum(self.counts.counts(pieces)))
            self.recoded += len(pieces)
        if not n and edits:  # nothing was there before
            whole = "".join(new for _, _, new in edits)
            pieces = self.counts.pieces(whole)
            self.sums[1] = sum(self.counts.counts(pieces))
            self.recoded += len(pieces)

    def _resync(self, fresh: str, behind: str, at: int, stop: int) -> tuple[list[str], int] | None:
        """(new pre-tokens, old place) of the first new cut on an old one behind the edits."""
        joined = fresh + behind
        final = stop == len(self.text)
        taken, place = [], 0
        for piece in self.counts.pieces(joined):
            if not final and place + len(piece) + CONTEXT > len(joined):
                return None
            taken.append(piece)
            place += len(piece)
            old = place - len(fresh) + at
            if place >= len(fresh) and old >= at:
                leaf = int(np.searchsorted(self.ends, old))
                if leaf < len(self.ends) and self.ends[leaf] == old:
                    return taken, old
        return (taken, stop) if final else None


def edits_of(text: str, rules: Sequence[tuple[regex.Pattern, str]]) -> list[tuple[int, int, str]]:
    """Leftmost matches of all rules; of overlapping ones the first, then the earlier rule's."""
    found = sorted(
        (m.start(), rank, m.end(), new) for rank, (rule, new) in enumerate(rules) for m in rule.finditer(text)
    )
    out, reached = [], 0
    for start, _, stop, new in found:
        if start >= reached:
            out.append((start, stop, new))
            reached = stop
    return out


def edited(text: str, edits: Sequence[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, stop, new in edits:
        out += [text[at:start], new]
        at = stop
    return "".join([*out, text[at:]])


def _count(path: str, rules: Sequence[tuple[str, str]]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        compiled = [(regex.compile(rule), new) for rule, new in rules]
        for batch in batches:
            ids = column(batch, "doc_id")
            own = column(batch, "text")
            for block in texts(own):
                rows = []
                for text in own.slice(block.first, len(block)).to_pylist():
                    tree = TokenTree(text or "", known)
                    before = tree.total
                    edits = edits_of(text or "", compiled)
                    tree.edit(edits)
                    rows.append((before, len(edits), tree.recoded, tree.total))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(block.first, len(block))] + [pa.array(list(c), pa.int64()) for c in zip(*rows)],
                    ["doc_id", "n_tokens", "n_edits", "n_recoded", "n_tokens_after"],
                )

    return count


def token_counts(
    docs: DataFrame, rules: Sequence[tuple[str, str]] = RULES, tokenizer: str | None = None
) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_recoded, n_tokens_after of every row.

    ``rules`` say what is replaced by what; n_recoded counts the pre-tokens that were
    coded again for it. A null text is empty. Rows are handled one by one, repeated
    rows alike, and other columns are not looked at.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(_count(path, list(rules)), _SCHEMA)


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"))
