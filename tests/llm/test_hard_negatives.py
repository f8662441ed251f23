"""Packed products against plain ones, hard negatives against brute force and SQL."""

import math

import numpy as np
import pytest

from tabforge.llm import hard_negatives as hn
from tests.oracle import connect, differences

SCHEMA = "vec_id long, label int, embedding array<float>, tile int, part string, mark long"


@pytest.mark.parametrize("high", [0, 1, 159, 2**20, 2**31, 2**40, 10**12])
def test_products(high):
    rng = np.random.default_rng(high % 97)
    for m, n, d in ((3, 7, 5), (1, 1, 1), (5, 70, 64), (2, 3, 0), (0, 4, 3)):
        a, b = (rng.integers(-high, high + 1, (k, d)).astype(np.float64) for k in (m, n))
        plain = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b.tolist()] for p in a.tolist()]
        if any(abs(x) >= 2**63 for row in plain for x in row):
            with pytest.raises(OverflowError):
                hn.packed_products(a, b)
        else:
            assert hn.packed_products(a, b).tolist() == plain


def test_extremes_fill_their_fields():
    for d, high in ((64, 159), (3, 2**10), (1, 2**24)):
        full = np.full((2, d), float(high))
        both = np.concatenate([full, -full, np.zeros((1, d))])
        assert hn.packed_products(both, both).tolist() == (both @ both.T).astype(np.int64).tolist()
        assert hn.field_width(d, high, high) * (hn.WORD_BITS // hn.field_width(d, high, high)) <= hn.WORD_BITS


def brute(rows):
    """Rows (vec_id, label, vector) as given, every anchor against every row."""
    rows = [(i, l, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, l, v in rows
            if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)]
    rows = sorted(set(rows))
    out = []
    for anchor in rows:
        if anchor[0] % 100:
            continue
        scored = {(-sum(x * y for x, y in zip(anchor[2], v)), i, l) for i, l, v in rows if i != anchor[0] and len(v) == len(anchor[2])}
        positives = sorted((s, i) for s, i, l in scored if l == anchor[1])[:5]
        others = sorted((s, i) for s, i, l in scored if l != anchor[1])
        for s, i in positives:
            fit = [x for x in others if 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(anchor[0], i, k, j, -s, -t) for k, (t, j) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, parts=3):
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, hn.hard_negatives(table, hn.F.col("vec_id") % 100 == 0).collect()))


def vectors(n, d, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(k), int(rng.integers(0, 3)), (rng.random(d) * spread).astype(np.float32).tolist()) for k in range(n)]


def test_against_brute_force(spark):
    rows = vectors(450, 4, 1)
    rows += [(1000 + k, k % 3, [0.5, 0.5, 0.5, 0.5]) for k in range(60)]  # ties
    rows += rows[:40] + [(7, 1, [0.9, 0.9, 0.9, 0.9]), (100, 2, [0.9, 0.1, 0.9, 0.1])]  # repeated rows and ids
    rows += [(2000 + k, 0, v) for k, v in enumerate([None, [], [1.0, None, 1.0, 1.0], [math.nan] * 4, [math.inf] * 4, [1.0, 1.0], [0.0] * 4])]
    rows += [(2100, None, [1.0] * 4), (None, 1, [1.0] * 4), (2200, 1, [1.0, 2.0]), (2300, 1, []), (2301, 1, []), (2302, 2, []), (2400, 77, [1.0] * 4), (2500, 0, [-1.0] * 4)]
    expected = brute(rows)
    assert len(expected) > 50 and found(spark, rows) == expected


def test_blocks_and_tiles(spark, monkeypatch):
    """Many small blocks and tiles give the same rows."""
    rows = vectors(900, 3, 2)
    expected = brute(rows)
    monkeypatch.setattr(hn, "TILE_ROWS", 2)
    assert found(spark, rows, 7) == expected


def test_large_components(spark):
    rows = [(i, l, [x * 2.0**20 for x in v]) for i, l, v in vectors(300, 3, 3)]
    expected = brute(rows)
    assert expected and found(spark, rows) == expected


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(100, 1, [1.0])]) == []
    assert found(spark, [(100, 1, [1.0]), (1, 1, [1.0])]) == []


def test_query_agrees_with_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert differences(hn.op11_hard_negatives(spark, sf_dir), connect(sf_dir), hn.SQL) == []
