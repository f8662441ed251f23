"""Trees against coding the edited text from scratch."""

import public_tokenizers
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tabforge.llm.token_counts import RULES, Counter, TokenTree, edited, edits_of, token_counts

COUNTS = Counter(public_tokenizers.path("byte_bpe_50k.json"))


def whole(text):
    return len(COUNTS.library.encode(text, add_special_tokens=False).ids)


SIGNS = st.text(st.sampled_from(list("ab'lrevstdm  \n\t1²é日.,!<|>’ ")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(SIGNS, st.lists(st.tuples(st.integers(0, 60), st.integers(0, 8), st.text(st.sampled_from(list("a'l \n1.")), max_size=6)), max_size=5))
def test_edits(text, wanted):
    edits, reached = [], 0
    for start, n, new in sorted(wanted):
        start = min(max(start, reached), len(text))
        stop = min(start + n, len(text))
        if not edits or start > edits[-1][0] or start >= edits[-1][1]:
            edits.append((start, stop, new))
            reached = stop
    tree = TokenTree(text, COUNTS)
    assert tree.total == whole(text)
    tree.edit(edits)
    assert tree.total == whole(edited(text, edits))
    size = len(tree.sums) // 2
    assert all(tree.sums[k] == tree.sums[2 * k] + tree.sums[2 * k + 1] for k in range(1, size))


def test_only_the_neighbourhood_is_coded_again():
    text = "plain words follow each other here. " * 2000
    tree = TokenTree(text, COUNTS)
    edits = [(10_000, 10_005, "new"), (50_000, 50_000, "'s"), (len(text) - 3, len(text), "")]
    tree.edit(edits)
    assert tree.total == whole(edited(text, edits)) and tree.recoded < 60


ODD = [
    None, "", " ", "a@b.co", "mail a@b.co, 1.2.3.4 and +1 (319) 555-5132!", "<|endoftext|> it's 'll", "日本 é́ \x00\u0085  x   ", "x" * 40_000, "    " * 3000,
    'token = "ab12" Licensed under the Apache License, Version 2.0.\n4539578763621486', "a@b.co" * 50, "a@b.co\n" * 3000,
]


def test_odd_rows(spark):
    rows = [(k, t, 5) for k, t in enumerate(ODD)] + [(None, "a@b.co x", 1), (3, "a@b.co", 1), (3, "a@b.co", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    compiled = [(regex.compile(a), b) for a, b in RULES]
    expected = []
    for key, text, _ in rows:
        edits = edits_of(text or "", compiled)
        expected.append((key, whole(text or ""), len(edits), whole(edited(text or "", edits))))
    found = [(r.doc_id, r.n_tokens, r.n_edits, r.n_tokens_after) for r in token_counts(docs).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert token_counts(docs.limit(0)).collect() == []


@pytest.mark.parametrize("rules", [[], [("[aeiou]+", "")], [(r"\s+", " ")]])
def test_documents(spark, sf_dir, rules):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    compiled = [(regex.compile(a), b) for a, b in rules]
    for r in token_counts(docs, rules).collect():
        if r.doc_id % 7 == 0:
            assert r.n_tokens == whole(texts[r.doc_id])
            assert r.n_tokens_after == whole(edited(texts[r.doc_id], edits_of(texts[r.doc_id], compiled)))
