"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from tabforge.llm import ngram_jaccard as nj
from tabforge.llm.components import components
from tests.oracle import connect, differences


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups(nodes, links):
    label = {n: n for n in nodes}

    def top(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        label[high] = low
    return {n: top(n) for n in nodes}


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    links = [
        (a, b)
        for b in range(len(rows))
        for a in range(b)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    label = groups(range(len(rows)), links)
    out = []
    for k, (key, _) in enumerate(rows):
        ids = [rows[o][0] for o in label if label[o] == label[k] and rows[o][0] is not None]
        out.append((key, len(sets[k]), min(ids, default=None) if sets[k] else key))
    return sorted(out, key=str)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n long, c string")
    return sorted(
        (tuple(r)[:3] for r in nj.jaccard_join(docs.repartition(3), **how)[0].collect()), key=str
    )


def corpus(seed, n_bases=6, copies=9):
    rng = random.Random(seed)
    out = []
    for _ in range(n_bases):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([7, 30, 80, 150]))]
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 12)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
            cut = rng.randrange(0, 1 + len(own) // 4)
            out.append(" ".join(own[cut:]) if rng.random() < 0.5 else " ".join(own))
    return out


@pytest.mark.parametrize("tile, part", [(64, 200_000), (4, 200_000), (4, 3)])
def test_against_all_pairs(spark, monkeypatch, tile, part):
    monkeypatch.setattr(nj, "PART_ROWS", part)
    monkeypatch.setattr(nj, "BLOCK", 300)
    rows = list(enumerate(corpus(tile)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE  two"), (905, "one two three")]
    rows += [(906, "a " * 5000), (907, "a " * 300), (0, rows[0][1]), (0, rows[0][1]), (0, "clash of ids only"), (None, rows[9][1]), (None, None), (None, "lonely words")]
    assert found(spark, rows, tile=tile, cell_bits=6) == expected(rows)


def test_exact_border(spark):
    base = [f"w{k}" for k in range(11)]  # seven shingles; six of eight are shared below
    rows = [(1, " ".join(base)), (2, " ".join([*base[:10], "z"])), (3, " ".join(base[:9]))]
    assert found(spark, rows) == expected(rows)


def test_groups_of_near_copies(spark, monkeypatch):
    rng, rows = random.Random(8), []
    for group in range(2):
        words = [f"g{group}w{k}" for k in range(120)]
        for k in range(90):
            own = list(words)
            for _ in range(k // 12):
                own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            rows.append((1000 * group + k, " ".join(own[: 120 - rng.randrange(20)])))
    monkeypatch.setattr(nj, "BLOCK", 2000)
    assert found(spark, rows, tile=8) == expected(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_bitmaps_never_drop_a_link():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: int(rng.integers(0, n + 1))], rng.integers(0, 2**63, n // 4, dtype=np.uint64)]))
        x, y = nj.bitmap(a)[None], nj.bitmap(b)[None] if len(b) else nj.bitmap(a)[None]
        words = min(x.shape[1], y.shape[1])
        x, y = nj._fold(x, words), nj._fold(y, words)
        bound = len(a) - int(np.bitwise_count(x & ~y).sum())
        assert not len(b) or bound >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("per_part", [200_000, 7])
def test_components(spark, monkeypatch, per_part):
    monkeypatch.setattr("tabforge.llm.components.EDGES_PER_PART", per_part)
    rng = random.Random(5)
    links = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)] + [(100 + k, 101 + k) for k in range(40)]
    df = spark.createDataFrame(links, "a long, b long").repartition(20)
    links = [(a, b) for a, b in links if a != b]
    nodes = {n for link in links for n in link}
    assert {tuple(r) for r in components(df).collect()} == set(groups(nodes, links).items())


def test_query_agrees_with_sql(spark, sf_dir):
    assert differences(nj.op2_ngram_jaccard(spark, sf_dir), connect(sf_dir), nj.SQL) == []
