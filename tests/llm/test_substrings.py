"""Compact windows against the tree, passages against all pairs of documents."""

import random
import re

import numpy as np

from tabforge.llm import substrings
from tabforge.llm.substrings import common_passages, compact_windows, shared_passages


def tree(hashes, low, high, least):
    if high - low + 1 < least:
        return []
    at = low + int(np.argmin(hashes[low : high + 1]))
    return [(low, at, high), *tree(hashes, low, at - 1, least), *tree(hashes, at + 1, high, least)]


def test_windows_are_the_trees():
    rng = np.random.default_rng(4)
    for least in (1, 2, 3, 7, 46):
        parts = [rng.permutation(np.arange(1, 400, dtype=np.uint64))[: int(n)] for n in rng.integers(0, 300, 8)]
        flat, expected = [np.zeros(1, dtype=np.uint64)], []
        for p in parts:
            begin = sum(map(len, flat))
            expected += [tuple(begin + x for x in w) for w in tree(p, 0, len(p) - 1, least)]
            flat += [p, np.zeros(1, dtype=np.uint64)]
        found = compact_windows(np.concatenate(flat), least)
        assert sorted(zip(*(x.tolist() for x in found))) == sorted(expected)


def test_passages_of_two_sequences():
    left, right = np.arange(1000, 1200, dtype=np.uint64), np.concatenate([np.arange(5, dtype=np.uint64), np.arange(1050, 1110, dtype=np.uint64), np.arange(60, 90, dtype=np.uint64)])
    assert common_passages(left, np.arange(200), right, np.arange(95), 46) == [(50, 114, 5, 69, 60)]
    assert common_passages(left, np.arange(200), right[30:40], np.arange(10), 46) == []


def words(n, rng):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, start int, c string").repartition(3)


def test_planted_passages(spark):
    rng = random.Random(9)
    rows, planted = [], {}
    for group in range(6):
        passage = words(51 + 20 * group, rng)
        for copy in range(2 if group < 5 else 120):
            own = list(passage)
            if group == 3:  # slightly changed
                own[25] = f"x{copy}"
            before = words(rng.randrange(0, 60), rng)
            key = 1000 * group + copy
            rows.append((key, " ".join(before) + "\n" + " ".join(own).upper() + " " + " ".join(words(rng.randrange(0, 60), rng))))
            planted[key] = (len(before), len(before) + len(own), 1000 * group)
    rows += [(9000 + k, " ".join(words(rng.randrange(0, 300), rng))) for k in range(60)]
    rows += [(9100 + k, "Licensed under the terms of a common licence. " * 3 + " ".join(words(80, rng))) for k in range(40)]
    rows += [(9200, None), (9201, ""), (9202, "spam " * 9000), (9203, "spam " * 8000), (9204, "short copy"), (9205, "short copy")]
    same = " ".join(words(70, rng))
    rows += [(9300, same), (9301, same), (9301, same), (None, same), (9302, same.upper())]
    found = [tuple(r) for r in shared_passages(table(spark, rows)).collect()]
    by_id = {}
    for key, start, stop, n, other in found:
        by_id.setdefault(key, []).append((start, stop, other))
        assert n == stop - start
    assert set(by_id) == set(planted) | {9300, 9301, 9302, None}
    for key, (start, stop, first) in planted.items():
        (got,) = by_id[key]
        assert got[0] == start and got[1] == stop
        assert got[2] // 1000 == first // 1000
    assert by_id[9300] == [(0, 70, 9300)] and by_id[9301] == [(0, 70, 9300)] * 2 and by_id[9302] == [(0, 70, 9300)]


def test_similar_passages_are_mostly_found(spark):
    rng = random.Random(2)
    rows = []
    for k in range(60):
        passage = words(120, rng)
        changed = list(passage)
        for at in rng.sample(range(120), 2):
            changed[at] = "changed" + str(k)
        rows += [(2 * k, " ".join(words(30, rng) + passage)), (2 * k + 1, " ".join(changed + words(30, rng)))]
    found = {r.doc_id for r in shared_passages(table(spark, rows)).collect()}
    assert len(found) >= 110


def test_tables_without_passages(spark):
    assert shared_passages(table(spark, [])).collect() == []
    assert shared_passages(table(spark, [(1, "a b"), (2, "a b")])).collect() == []


def test_documents_against_exact_runs(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    where, repeated = {}, set()
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        seen = {}
        for k in range(len(w) - 4):
            seen.setdefault(tuple(w[k : k + 5]), k)
        own = sorted((k, s) for s, k in seen.items())
        keys = {tuple(s for _, s in own[k : k + 60]) for k in range(len(own) - 59) if own[k + 59][0] - own[k][0] == 59}
        for key in keys:
            repeated |= {r.doc_id, where[key]} if key in where else set()
            where.setdefault(key, r.doc_id)
    found = {r.doc_id for r in substrings.op8_substring_dedup(spark, sf_dir).collect()}
    assert repeated and repeated <= found


def test_equal_passages_around_a_common_line(spark):
    rng = random.Random(5)
    line = words(40, rng)
    rows, expected = [], {}
    for k in range(30):
        passage = words(12, rng) + line + words(12, rng)
        for copy in range(2):
            before = words(rng.randrange(0, 40), rng)
            rows.append((2 * k + copy, " ".join(before + passage + words(20, rng))))
            expected[2 * k + copy] = (len(before), len(before) + 64, 2 * k)
    rows += [(1000 + k, " ".join(words(30, rng) + line + words(30, rng))) for k in range(150)]
    found = {r.doc_id: (r.start, r.stop, r.other_id) for r in shared_passages(table(spark, rows)).collect()}
    assert found == expected


def test_passages_that_hold_an_earlier_line(spark):
    rng = random.Random(6)
    line = words(30, rng)
    passage = words(15, rng) + line + words(15, rng)
    twice = words(60, rng)
    rows = [
        (1, " ".join(line + words(40, rng) + passage + words(10, rng))),
        (2, " ".join(words(25, rng) + passage)),
        (3, " ".join(twice + words(30, rng) + twice)),
        (4, " ".join(words(20, rng) + twice)),
    ]
    found = {tuple(r) for r in shared_passages(table(spark, rows)).collect()}
    assert found == {
        (1, 70, 130, 60, 1), (2, 25, 85, 60, 1),
        (3, 0, 60, 60, 3), (3, 90, 150, 60, 3), (4, 20, 80, 60, 3),
    }


def test_other_id_is_the_smallest_of_the_group(spark):
    rng = random.Random(7)
    rows = []
    for group in range(2):
        passage = words(120, rng)
        for copy in range(60):
            own = list(passage)
            if group:  # each copy changed at places of its own: no 50 words are equal
                for at in (20 + copy % 10, 58 + copy % 7, 96 + copy % 8):
                    own[at] = f"x{copy}y{at}"
            rows.append((1000 * group + copy, " ".join(words(rng.randrange(0, 40), rng) + own + words(20, rng))))
    found = shared_passages(table(spark, rows)).collect()
    named = {}
    for r in found:
        named.setdefault(r.doc_id // 1000, set()).add(r.other_id)
    assert named[0] == {0}
    assert len({r.doc_id for r in found if r.doc_id >= 1000}) >= 50
    changed = {r.doc_id: r.other_id for r in found if r.doc_id >= 1000}
    assert set(changed.values()) == {min(changed)}


def merged(members, passages):
    """Extents per member, and which of them are tied together."""
    ends = sorted({(x[0], *x[2:4]) for x in passages} | {(x[1], *x[4:6]) for x in passages})
    extent, at = [], {}
    for m, start, stop in ends:
        if extent and extent[-1][0] == m and start <= extent[-1][2] + substrings.SLACK:
            extent[-1] = (m, extent[-1][1], max(extent[-1][2], stop))
        else:
            extent.append((m, start, stop))
        at[m, start, stop] = len(extent) - 1
    label = list(range(len(extent)))
    for x in passages:
        a, b = label[at[x[0], *x[2:4]]], label[at[x[1], *x[4:6]]]
        label = [min(a, b) if k in (a, b) else k for k in label]
    return list(zip(extent, label))


def test_large_groups_lose_no_pair(monkeypatch):
    rng = random.Random(3)
    line = [rng.randrange(10**9) for _ in range(36)]
    for bits, many in ((1 << 22, 1), (1 << 22, 8), (40, 2)):
        monkeypatch.setattr(substrings, "BIT_WORDS", bits)
        monkeypatch.setattr(substrings, "MANY", many)
        rows = []
        for group in range(6):
            core = [rng.randrange(10**9) for _ in range(rng.choice([60, 150]))]
            for _ in range(12):
                own = [rng.randrange(10**9) if rng.random() < rng.choice([0, 0.02, 0.15]) else w for w in core]
                own = own[rng.randrange(20) :] + ([rng.randrange(10**9) for _ in range(30)] + core[:55] if group == 1 else [])
                own += line + [rng.randrange(10**9) for _ in range(40)]
                rows.append(np.array(list(dict.fromkeys([rng.randrange(10**9) for _ in range(rng.randrange(9))] + own)), dtype=np.uint64))
        places = [np.arange(len(r)) for r in rows]
        for block in (np.zeros(len(rows), dtype=int), np.arange(len(rows)) % 2 + 3):
            expected = [
                (a, b, *f) for b in range(len(rows)) for a in range(b) if block[0] == block[1] or block[a] != block[b]
                for f in common_passages(rows[a], places[a], rows[b], places[b], 46)
            ]
            found = substrings.group_passages(rows, places, block, 46)
            assert merged(range(len(rows)), found) == merged(range(len(rows)), expected)
            assert len(found) < len(expected)


def test_changed_passages_around_a_common_line(spark, monkeypatch):
    """Pairs that share a changed passage, in a group that all texts with its line join."""
    rng = random.Random(11)
    line, rows = words(30, rng), []
    for pair in range(60):
        passage = words(18, rng) + line + words(18, rng)
        for copy in range(2):
            own = list(passage)
            own[17] = f"x{pair}y{copy}"  # 48 equal words at most
            rows.append((2 * pair + copy, " ".join(words(rng.randrange(20, 60), rng) + own + words(30, rng))))
    for block in (substrings.BLOCK, 3000):
        monkeypatch.setattr(substrings, "BLOCK", block)
        found = {r.doc_id: r.other_id for r in shared_passages(table(spark, rows)).collect()}
        assert len(found) >= 112
        assert all(other == key - key % 2 for key, other in found.items())


def test_all_members_of_a_group_meet():
    import pyarrow as pa

    rows = [(8, c) for c in range(10)] + [(16, c) for c in range(20)]
    names = ["key", "c", "low", "high"]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([r[1] for r in part])] + [pa.array([0] * len(part))] * 2, names)
        for part in (rows[:7], rows[7:18], rows[18:])
    ]
    met = [tuple(r.values()) for b in substrings._meet(16)(iter(batches)) for r in b.to_pylist()]
    assert sorted(r[:2] for r in met if not r[-1]) == [(a, b) for a in range(10) for b in range(a + 1, 10)]
    assert sorted(r[:2] for r in met if r[-1]) == [(c, 16) for c in range(20)]


def test_all_similar_parts_of_a_run_come_out():
    """Two alike parts of 50 shingles, 10 shared ones among 80 between them: too few for the whole, no gap is the widest."""
    own = np.arange(180, dtype=np.uint64)
    other = own + np.uint64(1000)
    same = np.r_[0:50, 58:130:8, 130:180]
    other[same] = own[same]
    at = np.arange(180)
    ((start, stop, *_), (begin, end, *_)) = common_passages(own, at, other, at, 46)
    assert start == 0 and stop >= 54 and begin <= 130 and end == 184
    kept = np.sort(np.r_[same, 60, 61])  # shingles left out count by the numbers of the others
    left = (own[kept], at[kept])
    assert common_passages(*left, other, at, 46, kept) == common_passages(own, at, other, at, 46)


def test_shingles_in_dense_stretches():
    rng = np.random.default_rng(8)
    for least in (6, 9, 12):
        nth = np.cumsum(rng.choice([1, 1, 1, 2, 4], 60))
        place = nth + np.cumsum(rng.choice([0, 0, 0, 0, 20], 60))
        expected = np.zeros(60, dtype=bool)
        for i in range(60):
            for j in range(i, 60):
                near = j == i or np.diff(place[i : j + 1]).max() <= substrings.GAP
                if near and 4 * (j - i + 1) >= max(3 * least, 3 * (nth[j] - nth[i] + 1)):
                    expected[i : j + 1] = True
        assert (substrings.dense(np.zeros(60, dtype=int), place, nth, least) == expected).all()


def test_windows_without_a_shared_stretch_stay_home(spark):
    """Texts that share a line of 30 words with many, but no passage, send no window."""
    from types import SimpleNamespace

    import pyarrow as pa

    from tabforge.llm.cells import twice_filter

    rng = random.Random(12)
    line, passage = words(30, rng), words(60, rng)
    rows = [(k, " ".join(words(100, rng) + line + words(100, rng) + passage * (k < 2))) for k in range(40)]
    docs = table(spark, rows).select("text")
    known = SimpleNamespace(value=twice_filter(docs, substrings._all_shingles(46), substrings.HELD_BITS))
    batch = pa.RecordBatch.from_arrays([pa.array([r.text for r in docs.collect()])], ["text"])
    sent = {c for b in substrings._windows(46, known)(iter([batch])) for c in b.column(0).to_pylist()}
    assert len(sent) == 2


def test_copies_in_other_tasks_hold_no_shingle_twice(spark, monkeypatch):
    """Copies spread over tasks send neither windows nor texts: their shingles are in one class."""
    rng = random.Random(13)
    own = [" ".join(words(120, rng)) for _ in range(12)]
    shared = words(70, rng)
    rows = [(100 * copy + k, text) for copy in range(4) for k, text in enumerate(own)]
    rows += [(7, " ".join(words(80, rng) + shared)), (8, " ".join(shared + words(80, rng))), (None, own[0])]
    docs = table(spark, rows).repartition(6)
    filters, make = [], substrings.twice_filter
    monkeypatch.setattr(substrings, "twice_filter", lambda *a: filters.append(make(*a)) or filters[-1])
    found = {(r.doc_id, r.start, r.stop, r.other_id) for r in shared_passages(docs).collect()}
    assert found == {(100 * c + k, 0, 120, k) for c in range(4) for k in range(12)} | {(7, 80, 150, 7), (8, 0, 70, 7), (None, 0, 120, 0)}
    assert np.unpackbits(filters[0]).sum() <= 70 - 4  # the shared passage alone


def test_shingles_meet_by_more_bits_than_there_are_shingles(spark):
    from tabforge.llm.cells import may_hold, twice_filter

    rng = np.random.default_rng(14)
    shingles = rng.integers(0, 2**63, 300_000).astype(np.uint64) * np.uint64(2)
    near = (np.uint64(5) << np.uint64(60)) + (np.arange(200, dtype=np.uint64) << np.uint64(29))  # alike in 32 bits
    sent = np.concatenate([shingles, shingles[:1000], near])
    rows = spark.createDataFrame([(k,) for k in range(4)], "part int").repartition(4)
    known = twice_filter(rows, lambda batches: (sent[k::4] for b in batches for k in b.column(0).to_pylist()), 27)
    assert may_hold(known, shingles[:1000]).all()
    assert np.unpackbits(known).sum() <= 1010
    assert [substrings.held_bits(n) for n in (0, 10**8, 2 * 10**8, 10**12)] == [27, 27, 28, 29]
