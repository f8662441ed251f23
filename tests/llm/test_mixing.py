"""The mix against targets found by refilling, blocks counted by hand, and reruns."""

import collections
import re

import pytest

from tabforge.llm import mixing
from tests.oracle import connect, differences


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def refilled(sizes):
    """Targets by resharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, full, left = dict.fromkeys(names, 0.0), set(), sum(sizes.values())
    while left > 1e-9 and len(full) < len(names):
        total = sum(weight[s] for s in names if s not in full)
        share = {s: left * weight[s] / total for s in names if s not in full}
        left = 0
        for s, more in share.items():
            target[s] += more
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                full.add(s)
    return target


def table(spark, rows):
    return spark.createDataFrame(
        [(k, t, s, 5, "x", 0) for k, t, s in rows],
        "doc_id long, text string, source string, size int, code string, n_chars long",
    )


def corpus():
    rows = [(k, " ".join(f"d{k}w{i}" for i in range(1 + (k * 37) % 300)), f"s{k % 7}" if k % 5 else "hot") for k in range(240)]
    rows += [(500 + k, f"tiny{k} words", s) for k, s in enumerate(["rare", "é", "Z", None, ""])]
    rows += [(600, None, "hot"), (601, "", "empty only"), (602, " \n", "empty only"), (None, "no id here", None)]
    rows += [(3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (3, "another text", "s3"), (700, "long " * 20_000, "long")]
    return rows


def test_targets_and_caps(spark):
    rows = corpus()
    found = mixing.Mix(table(spark, rows).repartition(4)).report().collect()
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    target = refilled(sizes)
    assert sorted((str(r.doc_id), r.size) for r in found) == sorted((str(k), len(words(t))) for k, t, _ in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    by_size = {(sizes[s], round(target[s], 6)) for s in sizes}
    assert {(r.source_size, round(r.target, 6)) for r in found} == by_size
    taken = collections.Counter()
    for r in found:
        taken[r.source_size, r.target] += r.taken
    for (size, wanted), n in taken.items():
        assert abs(n - wanted) <= max(0.05 * wanted, 2 * mixing.BLOCK)


def test_reruns_agree(spark):
    rows = corpus()
    first, second = (
        sorted(map(str, mixing.Mix(table(spark, r).repartition(p)).report().collect()))
        for r, p in ((rows, 3), (rows[::-1], 5))
    )
    assert first == second


def test_documents_are_the_blocks(spark):
    rows = corpus()
    mix = mixing.Mix(table(spark, rows))
    taken = collections.Counter()
    for r in mix.report().collect():
        taken[r.doc_id] += r.taken
    found = mix.documents()
    assert found.columns == mix.docs.columns
    written, texts = collections.Counter(), collections.defaultdict(set)
    for key, text, _ in rows:
        texts[key] |= set(words(text))
    for r in found.collect():
        assert r.n_chars == len(r.text) and r.text == " ".join(words(r.text)) and set(words(r.text)) <= texts[r.doc_id]
        written[r.doc_id] += len(words(r.text))
    assert written == collections.Counter({k: n for k, n in taken.items() if n})


def test_permutations_and_slots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 2)
    monkeypatch.setattr(mixing, "SHARD", 16)
    mix = mixing.Mix(table(spark, corpus()))
    rows, blocks = mix.chosen.collect(), {r.code: r.n_blocks for r in mix.plan.collect()}
    epochs = collections.defaultdict(set)
    for r in rows:
        seen = epochs[r.code, r.j // blocks[r.code]]
        assert 0 <= r.block < blocks[r.code] and r.block not in seen
        seen.add(r.block)
    per_shard = collections.Counter(r.shard for r in rows)
    assert max(per_shard.values()) <= 17
    for code, n in blocks.items():
        own = sorted(r.j for r in rows if r.code == code)
        assert own == list(range(len(own)))


@pytest.mark.parametrize("rows", [[], [(1, None, "a"), (2, " ", None)]])
def test_nothing_to_take(spark, rows):
    mix = mixing.Mix(table(spark, rows))
    assert [(r.size, r.target, r.taken) for r in mix.report().collect()] == [(0, 0.0, 0)] * len(rows)
    assert mix.documents().collect() == []


def test_query_agrees_with_sql(spark, sf_dir):
    assert differences(mixing.op3_mix_sources(spark, sf_dir), connect(sf_dir), mixing.SQL) == []
