"""Base spans against the plain patterns, the trees against the library, odd texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tabforge.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


ODD = [
    None, "", "no data", "a@b.c", "a@b.c_d@e.f x@y", "é.a@b.co, 👩‍👩‍👧 x%y+z@a-b.c.d!", "@a.b a@ a@.b a@b", "1.2.3.4.5.6.7.8.9",
    "256.1.1.1 1.2.3 0001.002.03.255 99999999999999999999999.1.1.1", "4539578763621486 4539 5787-6362 1486 4539578763621487",
    "+1 (319) 555-5132 and +44 20 7946 0958. +1 2 +1(((((((((5", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5", "x4539578763621486y 1.1.1.1@a.b",
    "+1.2.3.4 5 6 7 8 9 0 ", "joe [at] mail (dot) com", "call 319-555-5132 now", "a" * 30_000, "7" * 30_000, "7 " * 9000, "+" + "1-" * 9000,
    "a@" + "b." * 8000 + "c", "1." * 9000 + "1", "٣٤٥ 1.2.3.4\x00\n5.6.7.8", "a@b.c " * 300,
]


def test_base_spans(spark):
    rows = [(k, t, 1, "s") for k, t in enumerate(ODD)] + [(None, "a@b.c", 1, "s"), (3, "a@b.c", 1, "s"), (3, "1.2.3.4", 1, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int, spans string")
    found = pii.find_personal_data(docs.repartition(3))
    expected = []
    for key, text, _, _ in rows:
        spans = base(text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        expected.append((key, *(sum(s[0] == k for s in spans) for k in PLAIN), digest))
    assert sorted((tuple(r)[:6] for r in found.collect()), key=str) == sorted(expected, key=str)


def test_documents_and_added_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.op5_personal_data(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = [f"{k}:{a}:{b}" for k, a, b in base(texts[r.doc_id])]
        spans = list(filter(None, r.spans.split(",")))
        assert set(own) <= set(spans) and r.n_spans == len(spans) == len(own) + r.n_added
        for kind, a, b in (x.split(":") for x in spans if x not in own):
            assert kind == "secret" and re.search(r'token = "$', texts[r.doc_id][: int(a)])
            assert re.fullmatch("[0-9a-f]{40}", texts[r.doc_id][int(a) : int(b)])
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()


def test_trees_become_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.candidates(docs).select(F.explode("loose").alias("c"))
    rows = rows.select("c", F.col("c.touches").cast("double").alias("label"), *[F.col(f"c.f.{n}").alias(n) for n in pii.FEATURES])
    packed = pii.VectorAssembler(inputCols=[*pii.FEATURES], outputCol="features").transform(rows)
    model = pii.GBTClassifier(maxIter=5, maxDepth=3, seed=1, labelCol="label").fit(packed)
    scored = model.transform(packed).withColumn("ours", F.expr(pii.score_sql(model))).collect()
    assert len(scored) > 50
    assert all(abs(r.ours - r.probability[1]) < 1e-9 for r in scored)


def test_similar_candidates_are_added(spark):
    rows = [(k, f"words and contact {'abcdefg'[k % 7] * (3 + k % 9)}@mail.org for more" if k % 3 else f"see item {1000000 + k} there") for k in range(400)]
    rows += [(1000, "words and contact joe [at] mail.org for more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert found[1000].spans == "email:18:35" and found[1000].n_email == 0
    assert all(not r.n_added for k, r in found.items() if k < 1000)
    safe = pii.redact(docs.join(pii.find_personal_data(docs).select("doc_id", "spans"), "doc_id"))
    assert {r.doc_id: r.text for r in safe.collect()}[1000] == "words and contact [email] for more"


def test_planted_data_are_found(spark):
    """Data that no base rule catches: recall and precision of the added spans."""
    rng = random.Random(4)

    def digits(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def secret():
        return "".join(rng.choice("0123456789abcdef") for _ in range(40))

    planted = {
        "email": lambda: f"{rng.choice(['ann', 'bob', 'eve'])}{digits(2)} [at] mail{digits(1)}.example.org",
        "phone": lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
        "secret": secret,
    }
    decoys = [
        lambda: f"item {digits(9)}", lambda: f"{digits(8)} {digits(8)} {digits(8)}", lambda: f"x{digits(12)}y",
        lambda: f"{digits(3)}.{digits(3)}.{digits(3)}.9{digits(3)}", lambda: "-" * 30 + digits(2), lambda: "abcdef" * 5 + digits(1),
    ]
    rows, expected = [], set()
    for k in range(600):
        text = f"words number {k} "
        if k % 2:
            kind = rng.choice(list(planted))
            value = planted[kind]()
            text += 'and token = "' if kind == "secret" else "and "
            expected.add((k, f"{kind}:{len(text)}:{len(text) + len(value)}"))
            text += value + ('" then' if kind == "secret" else " then")
        else:
            text += f"and {rng.choice(decoys)()} then"
        rows.append((k, text + " +1 (319) 555-5132 and a.b@mail.org " * (k % 3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = set()
    for r in pii.find_personal_data(docs).collect():
        own = {f"{k}:{a}:{b}" for k, a, b in base(rows[r.doc_id][1])}
        found |= {(r.doc_id, x) for x in filter(None, r.spans.split(",")) if x not in own}
    assert len(found & expected) >= 0.9 * len(expected) and len(found & expected) >= 0.95 * len(found)


def test_spans_never_cut_a_run_or_join_cards(spark):
    rows = [(k, f'token = "{10**8 + k}156f3f99059" and 4539578763621486 4539578763621487 {k}') for k in range(90)]
    rows += [(1000 + k, f"call (319) 555-{1000 + k} or see {10**6 + k}") for k in range(90)]
    for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id < 1000").collect():
        text = rows[r.doc_id][1]
        for kind, a, b in (x.split(":") for x in filter(None, r.spans.split(","))):
            assert kind != "phone" and not re.search("[A-Za-z0-9]$", text[: int(a)]) and not re.match("[A-Za-z0-9]", text[int(b) :])


@pytest.mark.parametrize("rows", [[], [(1, "plain words")]])
def test_nothing_to_learn(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.spans for r in pii.find_personal_data(docs).collect()] == [""] * len(rows)


def test_thresholds_of_a_rare_kind(spark):
    rows = [(k, " ".join(f"see item {1000000 + 200 * k + j} there" for j in range(200))) for k in range(200)]
    rows += [(1000 + k, f"words and contact {'abcdefg'[k % 7] * (3 + k % 9)}@mail.org for more") for k in range(90)]
    rows += [(2000, "words and contact joe [at] mail.org for more")]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(r.doc_id, r.spans) for r in found.where("n_added > 0").collect()] == [(2000, "email:18:35")]
