"""Quality rules against counting by hand, and against the labels."""

import collections
import re

from tabforge.llm import quality
from tests.oracle import connect, differences


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    seen = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {p for i in range(n - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    base = (n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered))
    return (*base, n < 50 or 100 * len(covered) > 50 * n)


ODD = [
    None, "", " \n\t", "word", "a b c a b c a", "x " * 120, "x y " * 3000, "a\nb\na\n \n\nb \n",
    "a\x0bb\x0cc\rd e\x1cf é́ 👩‍👩‍👧 ß", "#*$%&|<> " * 60, "THE!! " * 70, "w" * 5000,
    " ".join(f"w{k}" for k in range(400)) + ".", " ".join(f"w{k % 50}" for k in range(400)),
]


def report(spark, rows):
    docs = spark.createDataFrame(
        [(k, t, "x", 1, True) for k, t in rows],
        "doc_id long, text string, code string, n_words int, placed boolean",
    )
    return docs, quality.quality_report(docs)


def test_counts(spark):
    rows = list(enumerate(ODD)) + [(3, "word"), (3, "other"), (None, "a b c " * 40)]
    docs, found = report(spark, rows)
    got = sorted((tuple(r)[:7] for r in found.collect()), key=str)
    assert got == sorted(((k, *counts(t)) for k, t in rows), key=str)
    assert all(not r.kept for r in found.collect() if r.base_failed)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in found.where("kept").collect())


def test_empty_table(spark):
    docs, found = report(spark, [])
    assert found.collect() == [] and quality.keep_good(docs).collect() == []


def test_rules_find_the_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels = labels.select("doc_id", labels.quality.alias("label"))
    rows = quality.quality_report(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = ([r.kept for r in rows if r.label == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_estimates_follow_the_votes(spark):
    clean = " ".join(f"word{chr(97 + k % 26)}" for k in range(40))
    texts = [". ".join(f"Plain{a}{b} words here" for b in "abcdefghijklmnopqrst") + f" {a}." for a in "abcdefghijklmnopqrstuvwxyz"]
    texts += [f"### {clean} $$$ %%% &&& *** {a} ||| <<< >>> ### $$$" for a in "abcdef"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    codes = quality.measured(docs).select(quality.F.expr(quality._CODE).alias("code"))
    learnt = quality.accuracies(codes).first()
    assert 0.7 < learnt.prior < 0.95 and learnt.bad[0] <= 0.05 and learnt.good[0] >= learnt.prior
    assert all(0 < r.quality < 1 for r in quality.posteriors(codes).collect())


GOOD = "Plain sentences follow here. " + " ".join(a + b + c for a in "bdfgk" for b in "aeiou" for c in ("ns", "rde", "llen", "mt", "sta")) + "."
BAD = "### " + " ".join(f"WORD{k}### $$$" for k in range(60))


def test_few_rows_do_not_overrule_the_prior(spark):
    """A plain text is kept and a bad one is not, whatever stands beside them."""
    for company in ([], [None], ["", None, " "], ["x"] * 8, [BAD] * 8, [GOOD] * 8, ["word " * 3] * 3 + [None] * 5):
        rows = [(1, GOOD), (2, BAD), *((10 + k, t) for k, t in enumerate(company))]
        found = {r.doc_id: r for r in report(spark, rows)[1].collect()}
        assert found[1].kept and not found[1].base_failed and not found[2].kept


def test_a_bad_rule_is_learnt_to_be_bad(spark, monkeypatch):
    """Without the anchor, bad votes that fall on good documents lose their weight."""
    monkeypatch.setattr(quality, "ANCHOR", 0.0)
    votes = [0 if i % 10 < 3 else 2 for i in range(1000)]  # what five rules agree on
    codes = [sum(v * 3**k for k in range(7) if k not in (2, 5)) + 3**2 + (0 if i % 2 else 3**5) for i, v in enumerate(votes)]
    learnt = quality.accuracies(spark.createDataFrame([(c,) for c in codes], "code int")).first()
    assert learnt.bad[5] > 0.5 and learnt.bad[0] < 0.06


def test_query_agrees_with_sql(spark, sf_dir):
    assert differences(quality.op1_quality_rules(spark, sf_dir), connect(sf_dir), quality.SQL) == []
