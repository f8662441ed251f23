"""Language ID: trigrams by hand, the filter's promises, held-out accuracy."""

import zlib

import numpy as np
import pyarrow as pa

from tabforge.llm import language
from tabforge.llm.tokens import texts

ODD = [None, "", "123 !?", "a", "ab cd", "Été  Ça", "ΑΣ 日本", "x" * 3000, "é1é", "İx"]


def by_hand(text):
    signs, gap = [0], True
    for c in (text or "").lower():
        if c.isalpha():
            signs.append(ord(c))
            gap = False
        elif not gap:
            signs.append(0)
            gap = True
    if signs[-1]:
        signs.append(0)
    return [
        signs[k - 1] << 42 | signs[k] << 21 | signs[k + 1] for k in range(1, len(signs) - 1) if signs[k]
    ]


def test_trigrams():
    for size in (1, 20, 1 << 20):
        found = []
        for block in texts(pa.array(ODD, pa.string()), size):
            grams, bounds = language.trigrams(block)
            found += [grams[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        assert found == [by_hand(t) for t in ODD]


def test_filter_knows_what_it_holds():
    rng = np.random.default_rng(2)
    names = [f"l{k:03}" for k in range(70)]
    grams = {n: rng.integers(0, 2**63, 300, dtype=np.uint64) for n in names}
    model = language.Filter(names, grams)
    for k, n in enumerate(names):
        masks = model.holders(grams[n])
        assert np.all(masks[k // 64] >> np.uint64(k % 64) & np.uint64(1))
    other = model.holders(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    assert np.mean(other[0] & np.uint64(1)) < 0.01 and model.false.max() < 0.01


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(held) >= 0.97 * len(held)


def test_held_out_labels_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hidden = language.folded(docs).selectExpr("doc_id", "text", "IF(held_out, 'zz', lang) AS lang", "1 AS held_out")
    assert sorted(language.identify(docs).collect()) == sorted(language.identify(hidden).collect())


def test_odd_rows(spark):
    rows = [(k, t, "xx", 1) for k, t in enumerate(ODD)] + [(None, "hello there", "en", 1), (4, "hello there", None, 1), (4, "hello there", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    found = language.identify(docs).collect()
    assert len(found) == len(rows)
    assert {r.lang_pred for r in found if r.doc_id in (0, 1, 2)} == {"und"}
    assert all(r.held_out is False for r in found if r.doc_id is None)
    assert language.identify(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", docs.lang.substr(9, 0)).where("false").union(docs.selectExpr("doc_id", "text", "CAST(NULL AS string)", "1"))).collect()} == {"und"}
