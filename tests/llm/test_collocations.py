"""Collocations against brute force and SQL."""

import collections
import random
import re

import numpy as np
import pytest

from tabforge.llm import collocations as co
from tests.oracle import connect, differences

SCHEMA = "doc_id long, text string, lang string, n long, core int, phrase string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER))]


def brute(rows, least, longest=4, top=2000, cover=80):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    frequent = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    most = collections.Counter()
    for (lang, p), a in frequent.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                most[lang, p[i : i + k]] = max(a, most[lang, p[i : i + k]])
    kept = collections.defaultdict(list)
    for (lang, p), a in frequent.items():
        if (lang, p) in most and 100 * most[lang, p] >= cover * a:
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        kept[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, n[lang], -s)
        for lang, found in kept.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)
    )


def found(spark, rows, least, parts=3, **kw):
    docs = spark.createDataFrame([(k, t, lang, 1, 2, "x") for k, (lang, t) in enumerate(rows)], SCHEMA).repartition(parts)
    return sorted(map(tuple, co.collocations(docs, least, **kw).collect()))


ODD = [
    (None, "Alpha beta. gamma\tdelta  alpha beta"), ("und", "ALPHA BETA"), ("en", None), ("en", ""), ("en", " \t "), (None, None), ("en", ".,;:!?"),
    ("en", "a\x0bb\x0cc\rd e\nf"), ("de", "Ä ä É é 👩‍👩‍👧 ß\x85x \x01y"), ("en", "x " * 9000), ("en", "x y " * 700 + "z"), ("", "no language name"),
    ("en", "w" * 5000 + " v"), ("en", " ".join(f"w{k}" for k in range(300))), ("en", "x.x,x;x:x!x?x"),
]


def test_odd_texts(spark):
    rows = ODD * 3
    expected = brute(rows, 3)
    assert len(expected) > 30 and found(spark, rows, 3) == expected
    assert found(spark, rows, 3, top=5) == brute(rows, 3, top=5)
    assert found(spark, rows, 2, longest=2) == brute(rows, 2, longest=2)
    assert found(spark, rows, 2, longest=6, cover=50) == brute(rows, 2, longest=6, cover=50)


def test_random_texts(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    rows = []
    for k in range(150):
        text = " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 60)))
        rows += [(rng.choice(["en", "de", None]), re.sub(" (?=a)", rng.choice([" ", ". ", ", "]), text))] * rng.choice([1, 1, 1, 4])
    expected = brute(rows, 5)
    assert len(expected) > 100 and found(spark, rows, 5) == expected
    assert found(spark, rows, 5, parts=1, top=7) == brute(rows, 5, top=7)


def test_full_filters_only_thin_out(spark, monkeypatch):
    """Counts stay exact when the filters let everything through."""
    monkeypatch.setattr(co, "MOST_BITS", 13)
    monkeypatch.setattr(co, "may_hold", lambda bits, hashes: np.ones(len(hashes), dtype=bool))
    monkeypatch.setattr(co, "GATHERED_GRAMS", 50)
    monkeypatch.setattr(co, "GATHERED_BYTES", 500)
    known = {1: np.zeros(1, np.uint8)}
    words = "a b a b c. a b"
    docs = spark.createDataFrame([(words, "en")] * 4, "text string, lang string")
    batches = co.dictionary(docs).toArrow().to_batches()
    got = collections.Counter()
    for batch in co._spell([1, 2, 3, 4], known)(iter(batches)):
        for row in batch.to_pylist():
            got[row["phrase"]] += row["n"]
    assert got["a"] == 12 and got["a b"] == 12 and got["b a b c"] == 4 and got["a b a b"] == 4 and got["c"] == 4


def test_each_ngram_has_one_chunk(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 9)) for _ in range(3000))
    docs = spark.createDataFrame([(text, "en"), (text, "en")], "text string, lang string")
    chunks = co.dictionary(docs).collect()
    assert len(chunks) > 50 and sum(c.n * c.core for c in chunks) == 6000
    assert all(len(c.text.split(" ")) <= co.LONGEST_CORE + 3 for c in chunks)


def test_products_beyond_64_bits(spark):
    big = 2**62
    rows = [("en", 1, "a", big + 5), ("en", 1, "b", big + 7), ("en", 2, "a b", big)]
    phrases = spark.createDataFrame(rows, "lang string, width int, phrase string, f long")
    (row,) = co.scored(phrases).collect()
    assert row.score == 2_000_000 * big // (2 * big + 12) and (row.l, row.r) == (big + 5, big + 7)


def test_empty_table(spark):
    assert found(spark, [], 1) == [] and found(spark, [("en", "a b")], 2) == []
    assert found(spark, [(None, None)], 1) == []


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_agrees_with_sql(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    assert differences(co.op12_collocations(spark, sf_dir), connect(sf_dir), co.SQL) == []
