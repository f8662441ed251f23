"""The pipeline against SQL and plain Python, stage by stage, and odd tables."""

import collections
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from tabforge.llm import decontaminate, mixing, ngram_jaccard, quality

COLUMNS = "doc_id, text, lang, source, n_chars"


def plain(sf_dir):
    """Rows of run(): filters by the stages' SQL, the mix's rounds and the ids in Python."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf_dir}/benchmark.parquet'")
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    for sql, kept in (
        (quality.SQL, "kept"), (ngram_jaccard.SQL, "doc_id = component_id"), (decontaminate.SQL, "NOT contaminated"),
    ):
        con.execute(f"CREATE TABLE next AS SELECT {COLUMNS} FROM documents WHERE doc_id IN (SELECT doc_id FROM ({sql}) WHERE {kept})")
        con.execute("DROP TABLE documents")
        con.execute("ALTER TABLE next RENAME TO documents")
    blocks = mixing.SQL[: mixing.SQL.rindex("g AS (")].rstrip().rstrip(",")
    times = {(c, b): n for c, b, n in con.execute(f"{blocks} SELECT code, block, times FROM m").fetchall()}
    starts = con.execute(f"{blocks} SELECT doc_id, code, start FROM o").fetchall()
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = []
    for key, code, start in starts:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[key])
        for r in (1, 2, 3):
            own = [w for k, w in enumerate(words) if times.get((code, (start + k) // mixing.BLOCK), 0) >= r]
            if own:
                rows.append((key, " ".join(own)))
    coder, at, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for key, text in sorted(rows):
        ids = [*coder.encode(text, add_special_tokens=False).ids, 2]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_against_the_plain_version(spark, sf_dir):
    expected = plain(sf_dir)
    found = [tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert len(expected) > 50 and sorted(found, key=lambda r: r[1]) == expected


def test_stages_return_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, sf_dir)
        assert (found.columns == docs.columns) == (k < 4)


def test_odd_tables(spark, sf_dir):
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("ns", "rde", "llen", "mt", "sta")]
    text = "Plain sentences follow here. " + " ".join(words) + "."
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (None, None, None, None, None), (2, "", "en", None, 0), (3, "x " * 9000, "en", "a", 1), (4, text + " more", None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        sizes = []
        for _, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, sf_dir)
            rows_now = found.collect()
            docs = spark.createDataFrame(rows_now, found.schema)
            sizes.append(len(rows_now))
        assert sizes[1] == (1 if given else 0)


def test_entry_points():
    names = entry_points.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if re.match(r"op\d+_", k)}
    assert "pipeline" in names
    assert collections.Counter(k.split("_")[0] for k in names if re.match(r"op\d+_", k)).most_common(1)[0][1] == 1
    with pytest.raises(KeyError):
        entry_points.oracle_sql()["pipeline"]
