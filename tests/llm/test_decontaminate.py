"""Decontamination against a loop over all windows."""

import hashlib
import random
import re

from tabforge.llm.decontaminate import SQL, decontaminate, op9_decontaminate
from tests.oracle import connect, differences


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def expected(docs, items, size=10):
    out = []
    for key, text in docs:
        w, hit, held = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            n = min(size, len(p))
            for s in range(len(p) - n + 1 if p else 0):
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == p[s : s + n]:
                        hit |= set(range(at, at + n))
                        if item is not None:
                            held.add(str(item))
        digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(held), digest, bool(hit)))
    return sorted(out, key=str)


def found(spark, docs, items):
    d = spark.createDataFrame([(k, t, 7, "x") for k, t in docs], "doc_id long, text string, n long, win string")
    i = spark.createDataFrame([(k, t, "y") for k, t in items], "item_id long, text string, h string")
    return sorted((tuple(r) for r in decontaminate(d.repartition(3), i, filter_bits=8)[0].collect()), key=str)


def test_odd_rows(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(12)]
    passage = [" ".join(rng.choices(vocabulary, k=n)) for n in (10, 14, 25, 3, 2, 1)]
    items = [(k, p) for k, p in enumerate(passage)] + [(0, passage[0]), (40, ""), (41, None), (None, passage[1]), (10, "Größe é!")]
    docs = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for k in range(25)]
    docs += [(100 + k, f"x {p.upper()}. y, {p}!") for k, p in enumerate(passage)]
    docs += [(100, f"x {passage[0].upper()}. y, {passage[0]}!"), (100, "other text"), (None, passage[2])]
    docs += [(200, None), (201, ""), (202, " \n"), (203, "GRößE é größe-é"), (204, "w1 " * 400)]
    docs += [(205, passage[2][: len(passage[2]) // 2]), (206, passage[2].replace(" ", "  -- "))]
    assert found(spark, docs, items) == expected(docs, items)


def test_empty_tables(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert found(spark, [(1, "a b")], []) == [(1, 2, 0, 0, empty, False)]
    assert found(spark, [], [(1, "a b")]) == []


def test_query_agrees_with_sql(spark, sf_dir):
    assert differences(op9_decontaminate(spark, sf_dir), connect(sf_dir), SQL) == []
