import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from houselights.llm import suffix_dedup as s


def slow(rows, length):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(b[p:p + length] for _, b in texts for p in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                cover[p] += 1
                cover[p + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def key(row):
    return row[0] is not None, row


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    passage = " ".join(rng.choice(words) for _ in range(2000))
    out = []
    for i in range(250):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))
        if rng.random() < 0.6:
            at = rng.randrange(len(passage) - 400)
            text += passage[at:at + rng.randint(10, 300)] + rng.choice(words)
        if rng.random() < 0.5:  # many different surroundings of one passage
            text += passage[500:640] + rng.choice(words) + rng.choice("xyz")
        out.append((i, text))
    return out + [(300, None), (301, ""), (302, "a" * 500), (303, "ab" * 200), (304, out[3][1]), (5, out[5][1]),
                  (None, out[7][1][:150]), (None, "a" * 90)]


@pytest.mark.parametrize("length", [40, 77, 200])
def test_matches_brute_force(documents, rows, length):
    got = [tuple(r) for r in s.remove_repeats(documents(rows), length).collect()]
    assert sorted(got, key=key) == sorted(slow(rows, length), key=key)


def test_matches_across_bucket_boundaries(documents, rows, monkeypatch, spark):
    monkeypatch.setattr(s, "BUCKET_BYTES", 2000)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in s.remove_repeats(documents(rows), 60).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(got, key=key) == sorted(slow(rows, 60), key=key)


@pytest.mark.parametrize("name", [3, None])
def test_one_row_repeated(documents, name):
    rng = random.Random(11)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(150))
    hot = shared + "".join(rng.choice("abcdefgh ") for _ in range(200))
    rows = [(name, hot)] * 300 + [(n, f"{n}" * 9 + shared[:rng.randint(30, 150)] + f"{n}" * 9) for n in range(600, 660)]
    got = [tuple(r) for r in s.remove_repeats(documents(rows).repartition(7), 60).collect()]
    assert sorted(got, key=key) == sorted(slow(rows, 60), key=key)
    cuts = s._cut_blocks(60)
    batch = pa.RecordBatch.from_arrays([
        pa.array([name] * 3, pa.int64()), pa.array([9] * 3), pa.array([s.zstandard.compress(hot.encode())] * 3),
        pa.array([[{"spot": 0, "alone": False}]] * 3)], ["doc_id", "row", "packed", "wanted"])
    assert sum(x.num_rows for x in cuts(iter([batch, batch]))) == 1


def test_blocks_cover_every_start_once_and_depend_on_content():
    rng = random.Random(2)
    text = bytes(rng.randrange(97, 101) for _ in range(5000))
    first, anchor, count, mark = s.blocks(text, 100)
    starts = np.concatenate([np.arange(a, a + n) for a, n in zip(first, count)])
    assert (starts == np.arange(len(text) - 99)).all()
    assert ((anchor >= first + count - 1) & (anchor + s.ANCHOR <= first + 100)).all()
    moved = s.blocks(b"zz" + text, 100)
    assert set(mark.tolist()[1:]) <= set(moved[3].tolist())


def test_segments_of_a_long_text(monkeypatch):
    rng = random.Random(6)
    text = bytes(rng.randrange(97, 110) for _ in range(3000))
    monkeypatch.setattr(s, "_SEGMENT", 500)
    first, _, count, _ = s.blocks(text, 100)
    starts = np.concatenate([np.arange(a, a + n) for a, n in zip(first, count)])
    assert (starts == np.arange(len(text) - 99)).all()


def test_multikey_sort_groups_equal_suffixes():
    rng = random.Random(8)
    data = bytes(rng.choice(b"ab") for _ in range(400))
    start = np.arange(380)
    group = np.array([rng.randrange(2) for _ in start])
    item, segment = s.multikey_sort(group, start, np.frombuffer(data, np.uint8), 13)
    seen = Counter((group[i], data[i:i + 13]) for i in start)
    assert set(item.tolist()) == {i for i in start if seen[(group[i], data[i:i + 13])] > 1}
    by_segment = {}
    for i, g in zip(item, segment):
        by_segment.setdefault(g, set()).add((group[i], data[i:i + 13]))
    assert all(len(x) == 1 for x in by_segment.values()) and len(by_segment) == sum(n > 1 for n in seen.values())


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_reach_is_the_longest_agreement(size):
    rng = random.Random(3)
    rows = sorted((rng.choice([b"L" * s.ANCHOR, b"M" * s.ANCHOR]), bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))))
                  for _ in range(60))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([x for _, x in rows]), pa.array([x for x, _ in rows]), *[pa.array([0] * 60)] * 4],
        ["left", "right", "spot", "alone", "doc_id", "row"])
    parts = [batch.slice(at, size) for at in range(0, 60, size)]
    got = [x for b in s._reach_backwards(iter([parts[0].slice(0, 0), *parts])) for x in b.column(6).to_pylist()]
    want = [max(s._agreement(x, y) for m, (k, y) in enumerate(rows) if k == lead and m != n)
            for n, (lead, x) in enumerate(rows)]
    want[0], want[-1] = len(rows[0][1]), len(rows[-1][1])
    assert got == want


def test_nothing_to_sort():
    none = np.zeros(0, np.int64)
    for start in (none, np.array([0]), np.array([0, 1])):
        item, segment = s.multikey_sort(start * 0, start, np.frombuffer(b"abcdefghijklmnop", np.uint8), 12)
        assert len(item) == len(segment) == 0


def test_cut_merges_touching_spans():
    assert s.cut(b"0123456789", [(2, 4), (4, 6), (8, 9)]) == (b"01679", [(2, 6), (8, 9)])
    assert s.cut(b"", []) == (b"", [])


def test_edges(edge, nothing):
    rows = s.remove_repeats(edge).collect()
    assert len(rows) == edge.count()
    gone = {r.doc_id: r.n_removed for r in rows}
    assert gone[3] == gone[4] == gone[1] == 0 and gone[8] == 600
    assert s.remove_repeats(nothing).count() == 0
    with pytest.raises(ValueError):
        s.repeated_spans(nothing, 20)
