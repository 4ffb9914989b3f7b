import random

import numpy as np
import pytest
import xxhash

from houselights.llm import simhash_index as s


def slow_fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).translate(
        {c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    grams = [" ".join(words)] if 0 < len(words) < 3 else [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(marks):
    parent = list(range(len(marks)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(marks):
        for j in range(i):
            if bin(a ^ marks[j]).count("1") <= 3:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(marks))]


@pytest.mark.parametrize("text", [None, "", "One", "one two", "A b C d", "a  b\tc\n d", "ÄÖ b c é", "x " * 50])
def test_fingerprint_counts_shingles(text):
    assert s.fingerprint(None if text is None else text.encode()) == slow_fingerprint(text)


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(1000))
    whole = s.fingerprint(text.encode())
    monkeypatch.setattr(s, "_CHUNK", 64)
    assert s.fingerprint(text.encode()) == whole == slow_fingerprint(text)


def test_gray_rank_inverts_the_code():
    ranks = np.arange(4096, dtype=np.uint64)
    assert (s.gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


@pytest.mark.parametrize("room", [64, 1 << 20])
def test_index_finds_all_pairs_within_the_radius(room):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 62, 30, dtype=np.uint64)
    bits = np.concatenate([centres ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (3, 30), dtype=np.uint64))
                           for _ in range(20)])
    bucket = np.sort(rng.integers(0, 7, len(bits)))
    order = np.lexsort((s.gray_rank(bits), bucket))
    bits = bits[order]
    found = {(int(a), int(b)) for x, y in s.GrayIndex(bits, bucket).links(3, room) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits))
            if bucket[i] == bucket[j] and bin(int(bits[i] ^ bits[j])).count("1") <= 3}
    assert found == want


@pytest.mark.parametrize("hot", [1024, 3])
def test_components_match_brute_force(documents, hot):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["red", "blue", "sun", "moon", "tree", "wolf"]) + str(rng.randint(0, 40)) for _ in range(60))
            for _ in range(40)]
    rows = []
    for n in range(500):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "new" + str(rng.randint(0, 5))
        rows.append((1000 - n, " ".join(words)))
    got = {r.doc_id: r for r in s.near_duplicates(documents(rows), hot=hot).collect()}
    marks = [slow_fingerprint(t) for _, t in rows]
    roots = slow_components(marks)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(least.get(r, i), i)
    assert len(set(roots)) < len(rows)
    for (i, _), m, r in zip(rows, marks, roots):
        assert (got[i].fingerprint, got[i].component_id) == (format(m, "016x"), least[r])


def test_chain_of_links_is_one_component(spark):
    nodes = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)]
    roots = dict((r.node, r.root) for r in s.components(spark.createDataFrame(nodes, "a long, b long")).collect())
    assert set(roots.values()) == {0, 500} and len(roots) == 201


def test_edges(edge, nothing):
    rows = s.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {3, 4, 5, None} and {r.component_id for r in zero} == {3}
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert s.near_duplicates(nothing).count() == 0


def test_one_of_each(edge, nothing):
    kept = s.one_of_each(edge)
    assert kept.schema == edge.schema
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 in ids and 4 not in ids
    assert s.one_of_each(nothing).count() == 0
