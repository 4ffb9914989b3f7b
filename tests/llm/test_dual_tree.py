"""Product codes: the walk over two trees against all distances, whole results against a plain version."""

import hashlib
import math

import numpy as np
import pytest

from houselights.llm import dual_tree as t
from houselights.llm.common import table

SCHEMA = "vec_id bigint, embedding array<float>, label int, ids string, code string, error double, `of` int, n int"


def plain(rows, parts=4, entries=256, rounds=4):
    """rows (vec_id, embedding, label) to (vec_id, code, error, label_error, digest)."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    v = np.floor(np.array([r[1] for r in rows]) * 1024).astype(np.int64).reshape(len(rows), parts, -1)
    books = v[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        d = ((v[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        codes = d.argmin(axis=2)
        for k in range(parts):
            for e in range(books.shape[1]):
                mine = v[codes[:, k] == e, k]
                if turn < rounds and len(mine):
                    books[k, e] = [math.floor(sum(c) / len(c)) if sum(c) % len(c) else sum(c) // len(c)
                                   for c in mine.T.tolist()]
    error = np.take_along_axis(d, codes[:, :, None], 2)[:, :, 0].sum(axis=1).tolist()
    of = {}
    for r, x in zip(rows, error):
        of[r[2]] = of.get(r[2], 0) + x
    digest = hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in code), x, of[r[2]], digest)
                   for r, code, x in zip(rows, codes.tolist(), error)), key=repr)


def made(spark, rows):
    return spark.createDataFrame([(*r, "i", "c", 0.5, 1, 2) for r in rows], SCHEMA)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("n,entries,spread", [(1, 1, 5), (2000, 256, 300), (700, 37, 4), (333, 256, 1), (900, 200, 0)])
def test_walk_finds_the_nearest_entry(n, entries, spread):
    rng = np.random.default_rng(n)
    centres = rng.integers(-400, 400, (30, 6))
    points = centres[rng.integers(0, 30, n)] + rng.integers(-spread, spread + 1, (n, 6))
    codebook = points[rng.integers(0, n, entries)] + rng.integers(-1, 2, (entries, 6))
    tree = t.Tree.over(points[t.tree_order(points, t.LEAF)], t.LEAF)
    codes, counts, sums = t.nearest(tree, codebook)
    want = ((tree.points[:, None, :] - codebook[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert codes.tolist() == want.tolist()
    assert counts.tolist() == np.bincount(want, minlength=entries).tolist()
    assert all((sums[e] == tree.points[want == e].sum(axis=0)).all() for e in range(entries))


def test_whole_nodes_are_taken_where_entries_lie_apart():
    rng = np.random.default_rng(1)
    centres = np.arange(16)[:, None] * 10_000 + np.zeros((1, 4), np.int64)
    points = centres[rng.integers(0, 16, 2000)] + rng.integers(-50, 51, (2000, 4))
    tree = t.Tree.over(points[t.tree_order(points, t.LEAF)], t.LEAF)
    whole, rows, *_ = t.assign(tree, t.Tree.over(centres, 1), np.arange(16))
    # Only leaves that lie on one of the fifteen gaps stay open.
    assert sum(len(x[0]) for x in whole) < 200 and len(rows) <= 15 * t.LEAF


def test_whole_table(spark):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    want = plain([(r.vec_id, r.embedding, r.label) for r in vectors.collect()])
    assert result(t.digest(vectors)) == want
    assert result(t.digest(vectors.repartition(7), block=100)) == want


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(n, [float(x) for x in rng.normal(size=8).astype("f4")], n % 3 if n % 5 else None) for n in range(400)]
    rows += [(5, rows[7][1], 1)] * 200 + [(None, rows[9][1], None), (None, [0.5] * 8, 2), (1000, None, 1),
                                         (-1, [0.0] * 7 + [float("nan")], 1), (-2, [0.0] * 7 + [float("inf")], 1),
                                         (-3, [0.0] * 7 + [None], 1), (-4, [-0.0] * 8, 9)]
    assert result(t.digest(made(spark, rows).repartition(5))) == plain(rows)
    assert result(t.digest(made(spark, rows[:9]))) == plain(rows[:9])
    assert t.digest(made(spark, [])).collect() == [] and t.digest(made(spark, [(1, None, 1)])).collect() == []


def test_refused(spark):
    for bad in ([(1, [1.0] * 8, 1), (2, [1.0] * 4, 1)], [(1, [1.0] * 7, 1)], [(1, [1e30] * 8, 1)]):
        with pytest.raises(ValueError):
            t.digest(made(spark, bad)).collect()


def test_codes_decode(spark):
    vectors = table(spark, "/root/testdata/sf0.001", "embeddings")
    coded, books = t.compress(vectors)
    source = {r.vec_id: np.floor(np.array(r.embedding, float) * 1024) for r in vectors.collect()}
    for r in coded.collect():
        assert ((source[r.vec_id] - t.decode(r.code, books) * 1024) ** 2).sum() == r.error
