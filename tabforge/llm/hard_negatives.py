"""Hard negatives by exact inner products, several candidates to one wide integer.

Components become whole numbers. Those of several candidates are biased until none is
below nought and laid side by side as fields of one wide integer (Kronecker packing);
an anchor's component multiplies all of them at once, and the sums of the products can
be read off field by field, because no field ever outgrows its width. A double holds
whole numbers of 53 bits exactly, so the packed products are one matrix product;
where not even one field fits, fields are packed into Python's unbounded integers.

Candidates are packed into blocks where they are read, so no key decides how full a
block is. The anchors, a stated query set, are dealt into tiles of bounded size, and
every block meets every tile in a group of its own: blocks are sent once per tile and
tiles once per block. A group answers with a bounded number of rows per anchor. The
first round finds each anchor's positives, the second the negatives in their bands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabforge.llm.registry import query
from tabforge.llm.tokens import packed, unpacked
from tabforge.llm.vocab import column
from tabforge.session import settle
from tabforge.sources.tables import load

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative scores between so many hundredths of the positive and as much as it.
LOW = 80
#: Rows and bytes of one packed block, at most (a single longer vector is a block).
BLOCK_ROWS, BLOCK_BYTES = 16_384, 1 << 22
#: Anchors of one tile, about, and bytes.
TILE_ROWS, TILE_BYTES = 4_096, 1 << 21
#: Bits of the whole numbers that a double holds exactly.
WORD_BITS = 53
#: Fields of one unbounded integer.
WIDE_FIELDS = 32
#: Scores held at a time.
AT_ONCE = 1 << 21

_BLOCK = "dim int, kind string, ids binary, labels binary, vectors binary"
_FOUND = "anchor_id long, mark long, id long, score long"
_HARD = "anchor_id long, mark long, positive_id long, positive_score long, id long, score long"


def field_width(dims: int, high_a: int, high_b: int) -> int:
    """Bits that hold every sum of ``dims`` products of numbers in 0..2*high_a and 0..2*high_b."""
    return max(1, (4 * dims * high_a * high_b).bit_length())


def packed_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices of whole numbers, exact (int64).

    The numbers may be of any size; products that do not fit 64 bits raise OverflowError.
    """
    m, dims = anchors.shape
    n = len(candidates)
    if not (m and n and dims):
        return np.zeros((m, n), dtype=np.int64)
    high_a, high_b = int(np.abs(anchors).max()), int(np.abs(candidates).max())
    width = field_width(dims, high_a, high_b)
    fields = WORD_BITS // width
    if not fields:
        return _wide_products(anchors, candidates, high_a, high_b, width)
    a, b = anchors.astype(np.float64) + high_a, candidates.astype(np.float64) + high_b
    groups = -(-n // fields)
    words = np.zeros((groups, dims))
    for f in range(fields):
        part = b[f::fields]
        words[: len(part)] += part * float(1 << (width * f))
    sums = (a @ words.T).astype(np.int64)
    out = np.empty((m, groups * fields), dtype=np.int64)
    for f in range(fields):
        out[:, f::fields] = (sums >> (width * f)) & ((1 << width) - 1)
    # What the two biases added.
    out = out[:, :n]
    out -= (high_b * a.sum(axis=1)).astype(np.int64)[:, None]
    out -= (high_a * candidates.astype(np.float64).sum(axis=1)).astype(np.int64)[None, :]
    return out


def _wide_products(anchors, candidates, high_a: int, high_b: int, width: int) -> np.ndarray:
    a = [[int(x) + high_a for x in row] for row in anchors.tolist()]
    b = [[int(x) + high_b for x in row] for row in candidates.tolist()]
    out = np.empty((len(a), len(b)), dtype=object)
    mask, plain = (1 << width) - 1, [sum(row) - high_b * len(row) for row in b]
    for start in range(0, len(b), WIDE_FIELDS):
        rows = b[start : start + WIDE_FIELDS]
        words = [sum(x << (width * f) for f, x in enumerate(part)) for part in zip(*rows)]
        for i, row in enumerate(a):
            total = sum(x * w for x, w in zip(row, words))
            taken = high_b * sum(row)
            for f in range(len(rows)):
                out[i, start + f] = ((total >> (width * f)) & mask) - taken - high_a * plain[start + f]
    if any(not -(2**63) <= x < 2**63 for x in out.ravel()):
        raise OverflowError("an inner product does not fit 64 bits")
    return out.astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    finite = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    return rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)


def _whole(vectors: pa.Array, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of whole numbers as doubles) for each vector length."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    ends = np.asarray(vectors.offsets, dtype=np.int64)
    sizes = np.diff(ends)
    flat = np.floor(np.asarray(vectors.flatten(), dtype=np.float64) * scale)
    found = []
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        places = (ends[at] - ends[0])[:, None] + np.arange(size)
        found.append((at, flat[places].reshape(len(at), size)))
    return found


def _packed_matrix(matrix: np.ndarray) -> tuple[str, np.ndarray]:
    high = np.abs(matrix).max(initial=0)
    kind = next((k for k in ("int8", "int16", "int32") if high <= np.iinfo(k).max), "float64")
    return kind, matrix.astype(kind)


def _block(ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> list[pa.Array]:
    """The columns of ``_BLOCK``, one row: rows in order of label, so that a label is a slice."""
    order = np.argsort(labels, kind="stable")
    kind, small = _packed_matrix(matrix[order])
    return [
        pa.array([matrix.shape[1]], pa.int32()), pa.array([kind]),
        packed([ids[order]]), packed([labels[order]]), packed([small]),
    ]


def _cut(scale: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(size: int) -> pa.RecordBatch:
            ids, labels, parts = zip(*held.pop(size))
            made = _block(np.concatenate(ids), np.concatenate(labels), np.concatenate(parts))
            return pa.RecordBatch.from_arrays(made, [f.split()[0] for f in _BLOCK.split(", ")])

        for batch in batches:
            ids = np.asarray(column(batch, "vec_id"), dtype=np.int64)
            labels = np.asarray(column(batch, "label"), dtype=np.int64)
            for at, matrix in _whole(column(batch, "embedding"), scale):
                size = matrix.shape[1]
                most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (2 * size + 1)))
                for first in range(0, len(at), most):
                    own = at[first : first + most]
                    if sum(len(x[0]) for x in held.get(size, ())) + len(own) > most:
                        yield flush(size)
                    held.setdefault(size, []).append((ids[own], labels[own], matrix[first : first + most]))
            if sum(x[2].nbytes for parts in held.values() for x in parts) > 8 * BLOCK_BYTES:
                for size in list(held):  # many vector lengths
                    yield flush(size)
        for size in list(held):
            yield flush(size)

    return pack


def _read_block(table: pa.Table, row: int):
    """(ids, labels, matrix) of one packed block."""
    dim, kind = table.column("dim")[row].as_py(), table.column("kind")[row].as_py()
    part = {n: table.column(n).combine_chunks().slice(row, 1) for n in ("ids", "labels", "vectors")}
    ids, labels = unpacked(part["ids"], "int64")[0], unpacked(part["labels"], "int64")[0]
    return ids, labels, unpacked(part["vectors"], kind)[0].reshape(len(ids), dim)


def _first(ids: np.ndarray, scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k places of ``at`` with the highest scores, ties by smaller id."""
    own = scores[at]
    if len(at) > k:
        least = np.partition(own, len(own) - k)[len(own) - k]
        at = at[own >= least]
        own = scores[at]
    return at[np.lexsort((ids[at], -own))[:k]]


def _meet(search, schema: str, scale: int):
    """Score the anchors of a group against its blocks; ``search`` picks an anchor's rows."""
    names = [f.split()[0] for f in schema.split(", ")]

    def meet(anchors: pa.Table, blocks: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        sets = _whole(anchors.column("embedding"), scale) if len(anchors) else []
        facts = anchors.drop_columns(["embedding"]).to_pylist() if len(anchors) else []
        for b in range(len(blocks)):
            ids, labels, matrix = _read_block(blocks, b)
            for at, own in sets:
                if own.shape[1] != matrix.shape[1]:
                    continue
                step = max(1, AT_ONCE // len(ids))
                for first in range(0, len(at), step):
                    scores = packed_products(own[first : first + step], matrix)
                    for line, k in zip(scores, at[first : first + step].tolist()):
                        low, high = np.searchsorted(labels, facts[k]["label"], "left"), np.searchsorted(labels, facts[k]["label"], "right")
                        rows += search(facts[k], ids, line, int(low), int(high))
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    return meet


def _positives(k: int):
    def search(anchor: dict, ids, scores, low: int, high: int) -> list[tuple]:
        at = np.arange(low, high)
        best = _first(ids, scores, at[ids[low:high] != anchor["vec_id"]], k)
        return [(anchor["vec_id"], anchor["mark"], *x) for x in zip(ids[best].tolist(), scores[best].tolist())]

    return search


def _negatives(k: int, least: int):
    def search(anchor: dict, ids, scores, low: int, high: int) -> list[tuple]:
        rows, known = [], {}
        for band in anchor["bands"]:
            top = band["score"]
            if top not in known:
                at = np.flatnonzero((scores <= top) & (scores >= -((-least * top) // 100)))
                at = at[((at < low) | (at >= high)) & (ids[at] != anchor["vec_id"])]
                best = _first(ids, scores, at, k)
                known[top] = list(zip(ids[best].tolist(), scores[best].tolist()))
            rows += [(anchor["vec_id"], anchor["mark"], band["id"], top, *x) for x in known[top]]
        return rows

    return search


def _all_pairs(anchors: DataFrame, tiles: int, blocks: DataFrame, n_blocks: int, search, schema: str, scale: int) -> DataFrame:
    """``search`` for every anchor in every block; tiles and blocks meet in groups of their own."""
    left = anchors.withColumn("tile", F.pmod("mark", F.lit(tiles))).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    )
    # Each side of a group holds about one tile and one block.
    right = blocks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(n_blocks)).cast("int")).withColumn(
        "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))
    )
    meet = _meet(search, schema, scale)
    return left.groupBy("tile", "part").cogroup(right.groupBy("tile", "part")).applyInArrow(meet, schema)


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows of each key with their rank; rows repeated with an id count once."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, scale: int = SCALE, positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = LOW,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vectors`` has vec_id, label and embedding; other columns are not looked at.
    ``is_anchor`` says by vec_id or label which rows are anchors. Components become
    floor(scale * x); a score is the inner product with the anchor. Higher scores come
    first, ties by smaller vec_id. An anchor's positives are its first ``positives`` rows
    of the same label; for each, the first ``negatives`` rows of other labels that score
    at most as much and at least ``low`` hundredths of it are returned.

    Rows with a null id, label, vector or component, or one that is not finite, take no
    part. Vectors are compared with anchors of the same length only. Rows repeated with
    one id, label and vector count once, and a row with an anchor's id is neither its
    positive nor its negative. An anchor without positives or negatives has no row; an
    empty table gives none. Scores that do not fit 64 bits raise OverflowError.
    """
    rows = usable(vectors)
    blocks = settle(rows.mapInArrow(_cut(scale), _BLOCK))
    anchors = rows.where(is_anchor).withColumn("mark", F.xxhash64("vec_id", "label", "embedding"))
    anchors = settle(anchors.dropDuplicates(["vec_id", "label", "mark"]))
    n_blocks = blocks.count()
    n, size = anchors.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    tiles = max(1, -(-n // TILE_ROWS), -(-8 * size // TILE_BYTES))
    if not n_blocks:
        n_blocks = 1
    found = _all_pairs(anchors, tiles, blocks, n_blocks, _positives(positives), _FOUND, scale)
    bands = _ranked(found, ["anchor_id", "mark"], positives).groupBy("anchor_id", "mark").agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("bands")  # at most ``positives``
    )
    bands = settle(bands.select(F.col("anchor_id").alias("vec_id"), "mark", "bands"))
    found = _all_pairs(anchors.join(bands, ["vec_id", "mark"]), tiles, blocks, n_blocks, _negatives(negatives, low), _HARD, scale)
    hard = _ranked(found, ["anchor_id", "mark", "positive_id", "positive_score"], negatives)
    return hard.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


SQL = f"""WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
         coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
h AS (
  SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM h WHERE rank <= {NEGATIVES}"""


@query("op11_hard_negatives", SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
