import hashlib
import random
import re

import pyarrow as pa
import pytest

from houselights.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def slow(docs, items):
    windows = {}
    for name, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i:i + 13]), set()).add(str(name))
    out = []
    for i, text in docs:
        w, hit, names = split(text), set(), set()
        for window, owners in windows.items():
            for p in range(len(w) - len(window) + 1):
                if tuple(w[p:p + len(window)]) == window:
                    hit |= set(range(p, p + len(window)))
                    names |= owners
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(1)
    vocabulary = ["the", "of", "Sun", "éa", "moon", "b2", "x"]
    items = [(n, " ".join(rng.choice(vocabulary) + str(rng.randint(0, 3)) for _ in range(rng.randint(1, 40)))) for n in range(30)]
    items += [(30, None), (31, "..."), (32, "aa aa"), (33, "AA-aa"), (None, "no id but twelve words in it so one window of all is"), (34, items[3][1])]
    docs = []
    for n in range(150):
        text = " ".join(rng.choice(vocabulary) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.5:
            w = (rng.choice(items[:30])[1]).split()
            at = rng.randint(0, max(0, len(w) - 14))
            text += ", " + ("! ".join(w[at:at + rng.randint(10, 30)])).upper()
        docs.append((n, text))
    return docs + [(200, "AA aa aa"), (201, None), (202, ""), (203, "aa")], items


@pytest.mark.parametrize("room", [d.ROOM, 60])
def test_matches_brute_force(documents, spark, data, room):
    docs, items = data
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert (len(d.item_sets(benchmark, room)) > 1) == (room == 60)
    named = [(name if name is not None else "", text) for name, text in items]
    got = [tuple(r) for r in d.digest(d.hits(documents(docs), benchmark, room=room)).collect()]
    assert sorted(got) == sorted(slow(docs, named))


def test_batches_wait_for_the_next_automaton(spark, data, monkeypatch):
    docs, items = data
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    sets = d.item_sets(benchmark, 60)
    built = []
    monkeypatch.setattr(d, "read_items", lambda place, read=d.read_items: built.append(place) or read(place))
    texts = pa.record_batch([pa.array([t for _, t in docs])], ["text"])
    parts = [texts.slice(n, 10) for n in range(0, len(docs), 10)]
    whole = [x for _, found in d._in_turn(iter(parts), sets, 13, 0) for x in found]
    assert len(built) == len(sets) > 1
    assert whole == [x for _, found in d._in_turn(iter(parts), sets, 13, 0, room=1) for x in found]
    assert sum(len(d.read_items(place)) for place in sets) == sum(text is not None for _, text in items)
    assert list(d._in_turn(iter([]), sets, 13, 0)) == []


def test_spans_point_into_the_original_text(documents, spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    hit = item.upper().replace(" ", " -- ")
    text = f"Straße: ({hit}) und Ende"
    row = d.hits(documents([(1, text)]), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert [text[x.start:x.end] for x in row.spans] == [hit]
    assert row.item_ids == ["7"]


def test_twentieth_is_the_limit(documents, spark):
    benchmark = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    rows = [(n, "alpha beta " + "x " * (n - 2)) for n in (40, 41)]
    assert [r.contaminated for r in d.digest(d.hits(documents(rows), benchmark)).orderBy("doc_id").collect()] == [True, False]


def test_edges(edge, nothing, spark):
    benchmark = spark.createDataFrame([(1, "quick brown fox"), (2, None), (3, "")], "item_id long, text string")
    rows = d.digest(d.hits(edge, benchmark)).collect()
    assert len(rows) == edge.count()
    assert {r.doc_id for r in rows if r.contaminated} == {1, 2}
    assert {r.n_words for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert d.hits(nothing, benchmark).count() == 0
    assert d.digest(d.hits(edge, benchmark.limit(0))).where("contaminated").count() == 0
    kept = d.clean(edge, benchmark)
    assert kept.schema == edge.schema and kept.count() == edge.count() - 3
