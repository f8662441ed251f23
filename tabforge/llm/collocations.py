"""Phrases that stand together, counted in a dictionary of distinct chunks.

A parse cuts every piece of text into chunks where its words say so: a core begins at
the start of a piece and at every trigger word (a word whose hash is a multiple of
``PERIOD``), and after ``LONGEST_CORE`` words without one. A chunk is its core and the
next words, as many as a phrase can reach beyond it, so neighbouring chunks overlap. An
n-gram belongs to the chunk in whose core it begins, hence to one chunk only. Equal
passages give equal chunks wherever they stand; the distinct ones, with how often each
was parsed, are the dictionary in which everything is counted.

A phrase is never more frequent than any part of it. So words are counted first, then
pairs of frequent words, then longer n-grams all of whose pairs are frequent. These
counts go by hash and only thin out: bit filters, sized by what was found up to a fixed
size, say which n-grams are worth their text. Those are then counted by their text,
which is exact. Cuts, scores and covering phrases are joins of that table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.llm.cells import bit_filter, may_hold
from tabforge.llm.files import work_folder
from tabforge.llm.registry import query
from tabforge.llm.tokens import byte_set, chained, mix, ranges, signed, span_hash, texts
from tabforge.llm.vocab import column
from tabforge.session import settle
from tabforge.sources.tables import load

LEAST, LONGEST, TOP, COVER = 30, 4, 2_000, 80
SCALE = 2_000_000
PERIOD, LONGEST_CORE = 16, 64
#: Filter bits per known n-gram, and the largest filter (8 MB); beyond it filters thin out less.
BITS_EACH, MOST_BITS = 16, 26
#: Bytes of text, and n-grams, that a task combines before it hands them on.
GATHERED_BYTES, GATHERED_GRAMS = 1 << 23, 1 << 21
NO_LANG = "und"

_SEPARATORS = [*b".,;:!?", *range(0x0A, 0x0E)]
WORD = byte_set((0x20, 0x20), (0x09, 0x0D), *((b, b) for b in _SEPARATORS))
SEPARATOR = ~byte_set(*((b, b) for b in _SEPARATORS))
NOT_SPACE = byte_set((0x20, 0x20))

_CHUNKS = "lang string, core int, text string"
_COUNTS = "h long, n long"
_PHRASES = "lang string, width int, phrase string, n long"


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """String column of byte spans."""
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(sizes, out=offsets[1:])
    flat = data[ranges(starts, sizes)]
    made = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(flat))
    return made.cast(pa.string())


def core_starts(opens: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where cores begin, given where pieces begin."""
    place = np.arange(len(opens))
    cuts = opens | (hashes % np.uint64(PERIOD) == 0)
    last = np.maximum.accumulate(np.where(cuts, place, 0))
    return np.flatnonzero((place - last) % LONGEST_CORE == 0)


def _parse(beyond: int):
    """Texts -> their chunks, words in lower case and a space apart."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = column(batch, "lang")
            for block in texts(column(batch, "text")):
                starts, lengths = block.lower().spans(WORD)
                n = len(starts)
                if not n:
                    continue
                passed = np.cumsum(SEPARATOR[block.used], dtype=np.int64)
                opens = np.ones(n, dtype=bool)
                opens[1:] = passed[starts[1:]] != passed[(starts + lengths)[:-1] - 1]
                firsts = block.per_text(starts)
                opens[firsts[firsts < n]] = True
                at = core_starts(opens, span_hash(block.data, starts, lengths))
                to = np.append(at[1:], n)
                pieces = np.flatnonzero(opens)
                end = np.append(pieces, n)[np.searchsorted(pieces, at, side="right")]
                stop = np.minimum(to + beyond, end)
                begins = np.zeros(n + 1, dtype=np.int64)
                np.cumsum(lengths + 1, out=begins[1:])
                joined = block.data[ranges(starts, lengths + 1)]
                joined[begins[1:] - 1] = 0x20
                owner = np.searchsorted(block.bounds, starts[at], side="right") - 1 + block.first
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.take(pa.array(owner)).cast(pa.string()), pa.array(to - at, pa.int32()),
                        _strings(joined, begins[at], begins[stop] - 1 - begins[at]),
                    ],
                    ["lang", "core", "text"],
                )

    return parse


class _Words:
    """The words of some chunks: spans, hashes that know the language, owners."""

    def __init__(self, block, cores: np.ndarray, seeds: np.ndarray):
        self.data = block.data
        self.starts, self.lengths = block.spans(NOT_SPACE)
        bounds = block.per_text(self.starts)
        self.owner = np.repeat(np.arange(len(block)), np.diff(bounds))
        place = np.arange(len(self.starts))
        self.own = place - bounds[self.owner] < cores[self.owner]
        self.room = bounds[self.owner + 1] - place
        self.hashes = mix(span_hash(block.data, self.starts, self.lengths) ^ seeds[self.owner])

    def grams(self, width: int, known: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the n-grams that begin in a core and whose parts are known."""
        hashes = chained(self.hashes, width) if width > 1 else self.hashes
        good = self.own[: len(hashes)] & (self.room[: len(hashes)] >= width)
        part = min(2, width - 1)
        if part in known:
            found = may_hold(known[part], chained(self.hashes, part) if part > 1 else self.hashes)
            for k in range(width - part + 1):
                good &= found[k : k + len(good)]
        if width in known:
            good &= may_hold(known[width], hashes)
        at = np.flatnonzero(good)
        return at, hashes[at]


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(words, languages, parse frequencies) of about ``GATHERED_BYTES`` of chunks at a time."""

    def read(held: list[pa.RecordBatch]) -> Iterator[tuple]:
        table = pa.Table.from_batches(held).combine_chunks()
        cores, times = (np.asarray(table.column(c), dtype=np.int64) for c in ("core", "n"))
        coded = table.column("lang").combine_chunks().dictionary_encode()
        seeds = np.array([xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()], dtype=np.uint64)
        seeds = seeds[np.asarray(coded.indices)]
        for block in texts(table.column("text"), GATHERED_BYTES):
            own = slice(block.first, block.first + len(block))
            yield _Words(block, cores[own], seeds[own]), table.column("lang").slice(own.start, len(block)), times[own]

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHERED_BYTES:
            yield from read(held)
            held, size = [], 0
    if held:
        yield from read(held)


def summed(hashes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, their sums, a place of each)."""
    if not len(hashes):
        return hashes, times, np.zeros(0, dtype=np.int64)
    order = np.argsort(hashes)
    ordered = hashes[order]
    edges = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[edges], np.add.reduceat(times[order], edges), order[edges]


def _count(widths: list[int], known: dict[int, np.ndarray]):
    """Chunks -> how often each n-gram of the widths occurs, by hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            hashes, sums, _ = summed(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(signed(hashes)), pa.array(sums)], ["h", "n"])

        for words, _, times in _gathered(batches):
            for width in widths:
                at, hashes = words.grams(width, known)
                held.append((hashes, times[words.owner[at]]))
            if sum(len(h) for h, _ in held) >= GATHERED_GRAMS:
                yield flush()
                held.clear()
        if held:
            yield flush()

    return count


def _spell(widths: list[int], known: dict[int, np.ndarray]):
    """Chunks -> how often each n-gram that the filters know occurs, by its text."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs, times in _gathered(batches):
            for width in widths:
                at, hashes = words.grams(width, known)
                if not len(at):
                    continue
                _, sums, first = summed(hashes, times[words.owner[at]])
                at = at[first]
                last = at + width - 1
                sizes = words.starts[last] + words.lengths[last] - words.starts[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.combine_chunks().take(pa.array(words.owner[at])).cast(pa.string()),
                        pa.array(np.full(len(at), width), pa.int32()),
                        _strings(words.data, words.starts[at], sizes), pa.array(sums),
                    ],
                    ["lang", "width", "phrase", "n"],
                )

    return spell


def dictionary(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, core, text, n): the distinct chunks and how often each was parsed, as a written table."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").alias("text")
    )
    chunks = rows.mapInArrow(_parse(longest - 1), _CHUNKS).groupBy("lang", "core", "text").agg(F.count("*").alias("n"))
    path = work_folder(docs.sparkSession, "chunks")
    chunks.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _frequent(chunks: DataFrame, widths: list[int], known: dict[int, np.ndarray], least: int) -> np.ndarray:
    """A filter that knows every n-gram of the widths that may occur ``least`` times."""
    counted = chunks.mapInArrow(_count(widths, known), _COUNTS).groupBy("h").agg(F.sum("n").alias("n"))
    found = settle(counted.where(F.col("n") >= least).select("h"))
    bits = min(MOST_BITS, max(13, (BITS_EACH * found.count()).bit_length()))
    return bit_filter(found, "h", bits)


def frequent_phrases(chunks: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, width, phrase, f) of every word and phrase of up to ``longest`` words that occurs ``least`` times."""
    known: dict[int, np.ndarray] = {}
    known[1] = _frequent(chunks, [1], {}, least)
    if longest > 1:
        known[2] = _frequent(chunks, [2], known, least)
    if longest > 2:
        longer = _frequent(chunks, [*range(3, longest + 1)], known, least)
        known |= {width: longer for width in range(3, longest + 1)}
    spelt = chunks.mapInArrow(_spell([*range(1, longest + 1)], known), _PHRASES)
    summed_up = spelt.groupBy("lang", "width", "phrase").agg(F.sum("n").alias("f"))
    return summed_up.where(F.col("f") >= least)


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, width, phrase, a, l, r, score): each phrase with its lowest-scoring cut."""
    whole = phrases.where("width > 1").withColumn("k", F.explode(F.expr("sequence(1, width - 1)")))
    whole = whole.select(
        "lang", "width", "phrase", F.col("f").alias("a"), "k",
        F.expr("substring_index(phrase, ' ', k)").alias("_first"),
        F.expr("substring_index(phrase, ' ', k - width)").alias("_rest"),
    )
    first = phrases.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l"))
    rest = phrases.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r"))
    cuts = whole.join(first, ["lang", "_first"]).join(rest, ["lang", "_rest"])
    # Decimals: the product may pass 64 bits.
    score = f"({SCALE}BD * CAST(a AS DECIMAL(20, 0))) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))"
    cuts = cuts.withColumn("score", F.expr(score))
    best = cuts.groupBy("lang", "width", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return best.select("lang", "width", "phrase", "a", "c.l", "c.r", "c.score")


def covered(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, most): how often the most frequent longer phrase around each phrase occurs."""
    parts = F.expr(
        "flatten(transform(sequence(2, width - 1), w -> transform(sequence(1, width - w + 1),"
        " i -> array_join(slice(split(phrase, ' '), i, w), ' '))))"
    )
    inside = phrases.where("width > 2").select("lang", F.explode(parts).alias("phrase"), "f")
    return inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def first_of_each(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank, thinned out in even parts before."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = max(1, round((rows.count() / max(1, top)) ** 0.5))
    if parts > 1:
        own = Window.partitionBy("lang", "_part").orderBy(*order)
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
        rows = rows.withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= top).drop("_part", "_rank")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases.

    Texts are lower-cased (A-Z), split into pieces at ``[.,;:!?]`` and line ends, and
    those into words at spaces and tabs. A phrase has 2 to ``longest`` words of one piece
    and occurs a >= ``least`` times, overlaps included. Of its cuts into two the one that
    scores lowest counts, floor(2000000 * a / (l + r)), ties to the shorter first part.
    A phrase inside a longer one that occurs at least ``cover`` hundredths as often is
    dropped. n counts the language's words.

    A null language is ``und``; a null or empty text has no words; repeated rows count
    again; other columns are not looked at. A table without frequent phrases, or an empty
    one, gives no rows.
    """
    chunks = dictionary(docs, longest)
    phrases = settle(frequent_phrases(chunks, least, longest))
    sizes = chunks.groupBy("lang").agg(F.sum(F.col("n") * F.col("core")).alias("n"))
    kept = scored(phrases).join(covered(phrases), ["lang", "phrase"], "left").where(
        f"most IS NULL OR 100BD * CAST(most AS DECIMAL(20, 0)) < {cover}BD * CAST(a AS DECIMAL(20, 0))"
    )
    found = first_of_each(settle(kept), top).join(sizes, "lang")
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = rf"""WITH t AS (
  SELECT coalesce(lang, '{NO_LANG}') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (
  SELECT lang, k AS width, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM w, unnest(range(1, {LONGEST + 1})) AS ks(k), unnest(range(1, len(w) - k + 2)) AS s(i)
  GROUP BY ALL HAVING count(*) >= {LEAST}),
split AS (SELECT *, string_split(phrase, ' ') AS ws FROM g),
cuts AS (
  SELECT s.lang, s.phrase, s.f AS a, k, x.f AS l, y.f AS r,
         ({SCALE}::HUGEINT * s.f // (x.f + y.f))::BIGINT AS score
  FROM split s, unnest(range(1, s.width)) AS c(k)
  JOIN g x ON x.lang = s.lang AND x.phrase = array_to_string(ws[1:k], ' ')
  JOIN g y ON y.lang = s.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')),
best AS (SELECT DISTINCT ON (lang, phrase) * FROM cuts ORDER BY lang, phrase, score, k),
inside AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(f) AS most
  FROM split, unnest(range(2, width)) AS ms(m), unnest(range(1, width - m + 2)) AS p(i) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE most IS NULL OR 100 * most < {COVER} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= {TOP}"""


@query("op12_collocations", SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))
