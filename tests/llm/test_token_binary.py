"""Simple-8b coding, unit coding against the library, and whole files."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabforge.llm import simple8b
from tabforge.llm.files import SEPARATOR
from tabforge.llm.token_binary import op7_token_binary, piece, pieces, token_binary
from tabforge.llm.tokens import texts
from tabforge.llm.vocab import Coder

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(ids):
    words, offsets = simple8b.encode(np.array(ids, dtype=np.uint64))
    assert simple8b.decode(words, offsets, len(ids)).tolist() == ids


def test_simple8b_packs_small_ids():
    words, _ = simple8b.encode(np.ones(60_000, dtype=np.uint64))
    assert len(words) < 60_000 / 50
    assert len(simple8b.encode(np.zeros(1024, dtype=np.uint64))[0]) == 9


def coded(values, known=None):
    known = known or Coder(PATH, slots=1 << 8, kept_ids=64)
    out = []
    for block in texts(pa.array(values, pa.string()), 64):
        ids, bounds = known.code(block)
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    return out


ODD = [
    None, "", " ", "it's IT'S o'clock ''s", "<|startoftext|>a <|endoftext|> <|x", "á é ́x",
    "ΣΑΣ ς İI", "x y z\u0085w", "1234 5²³ ½", "日本語 text テキスト", "a\x1cb\x00c", "naïve Ærø—“q”…",
    "THE!! the,the.", "x" * 3000, "é" * 500, "Ⅷ ﬁ Å Ω", "a​b 👩‍👩‍👧", "a_b-c#d $5.00 50%",
]


whole = Tokenizer.from_file(PATH)
KNOWN = Coder(PATH, slots=1 << 8, kept_ids=64)


def test_units_agree_with_the_library():
    expected = [whole.encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert coded(ODD) == expected


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aAbé1²'<|>. \n\t́ Σß,!sS")), max_size=40), max_size=6))
def test_units_agree_with_the_library_on_any_text(values):
    assert coded(values, KNOWN) == [whole.encode(t, add_special_tokens=False).ids for t in values]


def expected_rows(rows):
    whole, at, out = Tokenizer.from_file(PATH), 0, []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for key, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def found_rows(df):
    order = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()]
    return sorted(order, key=lambda r: r[1])


def test_odd_rows(spark):
    rows = [(k % 9, t) for k, t in enumerate(ODD)] + [(None, "null id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, piece string, file long")
    assert found_rows(token_binary(docs.repartition(3))) == expected_rows(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_binary(docs).collect() == []


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert found_rows(op7_token_binary(spark, sf_dir)) == expected_rows([tuple(r) for r in docs.collect()])


def test_damage_is_noticed():
    made = piece(np.array([7, 9]), np.array([0, 0]), np.array([2, 1]), np.array([5, 6, 2], dtype=np.uint64))
    (keys, _, counts, ids), = pieces(made + SEPARATOR)
    assert (keys.tolist(), counts.tolist(), ids.tolist()) == ([7, 9], [2, 1], [5, 6, 2])
    for broken in (made, made[:-8] + SEPARATOR, b"x" * 8 + made + SEPARATOR, made + SEPARATOR + made[:16]):
        with pytest.raises(ValueError):
            list(pieces(broken))
