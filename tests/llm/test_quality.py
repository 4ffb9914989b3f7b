import random
import zlib

import numpy as np
import pytest

from houselights.llm import quality as q
from houselights.llm.common import table


def slow_buckets(text):
    words = (text or b"").split()
    if not words:
        return []
    data = b" " + b" ".join(words) + b" "
    grams = [data[i:i + n] for n in q.GRAMS for i in range(len(data) - n + 1) if b" " not in data[i + 1:i + n - 1]]
    return grams, words, list(zip(words, words[1:]))


@pytest.mark.parametrize("text", [b"a", b"ab c", b"a b c d", b"  hello\nworld x", "éa bc bc".encode(), b"x" * 40])
def test_bucket_counts(text):
    grams, words, pairs = slow_buckets(text)
    found = q.buckets(text)
    assert len(found) == len(grams) + len(words) + len(pairs)
    # Equal features share a bucket, so there are no more buckets than features.
    same = sum(a == b for a, b in pairs)
    assert len(set(found.tolist())) <= len(set(grams)) + len(set(words)) + len({x for x in pairs if x[0] != x[1]}) + (same > 0)


def test_buckets_depend_on_the_feature_alone():
    one, two = set(q.buckets(b"harbour").tolist()), set(q.buckets(b"the harbour bell").tolist())
    assert one <= two
    assert q._SAME in q.buckets(b"go go") and q.buckets(b"") .size == q.buckets(None).size == 0


def test_one_class_or_none():
    none = q.learn([])
    assert none.score(b"any text") == 0.5
    ids = np.array([1, 2], np.int32)
    assert q.learn([(ids, np.array([1, 1]), 1)] * 3).score(b"") > 0.99


def test_learns_labels_held_out(spark, documents):
    rng = random.Random(5)
    rows, marks = [], []
    for n in range(400):
        words = ["".join(rng.choice(["ba", "lo", "mi", "ten", "ra"]) for _ in range(rng.randint(1, 4))) for _ in range(40)]
        good = n % 3 > 0
        rows.append((n, " ".join(words if good else [w + rng.choice(["***", "$$$"]) for w in words])))
        marks.append((n, int(good)))
    docs, labels = documents(rows), spark.createDataFrame(marks + [(None, 1), (3, None), (4, 9)], "doc_id long, quality int")
    got = {r.doc_id: r for r in q.score(docs, q.train(docs, labels)).collect()}
    assert all(got[n].held_out == (zlib.crc32(str(n).encode()) % 5 == 0) for n, _ in rows)
    held = [(got[n].predicted, y) for n, y in marks if got[n].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_held_out_rows_teach_nothing(spark, documents):
    held = [n for n in range(200) if zlib.crc32(str(n).encode()) % 5 == 0]
    docs = documents([(n, f"text {n}") for n in range(200)])
    labels = spark.createDataFrame([(n, n % 2) for n in held], "doc_id long, quality int")
    assert q.train(docs, labels).intercept == 0.0


def test_sample_is_bounded(spark, documents):
    docs = documents([(n, f"text {n % 2}") for n in range(200)])
    labels = spark.createDataFrame([(n, n % 2) for n in range(200)], "doc_id long, quality int")
    seen = []
    original = q.learn
    try:
        q.learn = lambda rows, **settings: seen.append(len(rows)) or original(rows, **settings)
        q.train(docs, labels, sample=50)
    finally:
        q.learn = original
    assert seen == [50]


def test_repeated_rows_teach_once_and_stay_bounded(spark, documents, monkeypatch):
    seen = []
    monkeypatch.setattr(q, "learn", lambda rows, **settings: seen.append(rows) or q.Model(np.zeros(1), 0.0))
    labels = spark.createDataFrame([(n, n % 2) for n in range(60)], "doc_id long, quality int")
    plain = [(n, f"text {n}") for n in range(60)]
    q.train(documents(plain), labels)
    q.train(documents(plain + [plain[1]] * 500).repartition(9), labels)
    q.train(documents(plain + [(1, f"other {n}") for n in range(500)]), labels, sample=70)
    assert len(seen[0]) == len(seen[1]) and len(seen[2]) == 70
    assert all((a == b).all() and (m == n).all() and x == y for (a, m, x), (b, n, y) in zip(seen[0], seen[1]))


def test_accuracy_on_the_test_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = q.score(docs, q.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_edges(edge, nothing, spark):
    labels = spark.createDataFrame([(1, 1), (7, 0), (2, 1)], "doc_id long, quality int")
    model = q.train(edge, labels)
    rows = q.score(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert q.score(nothing, model).count() == 0
    assert q.train(nothing, labels).intercept == 0.0
    kept = q.keep(edge, model, threshold=0.0)
    assert kept.schema == edge.schema and kept.count() == edge.count()
