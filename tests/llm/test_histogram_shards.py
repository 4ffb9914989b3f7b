import hashlib
import zlib

import pytest

from houselights.llm import histogram_shards as h
from houselights.llm.common import stored


def slow(rows, shards):
    keyed = sorted(((hashlib.md5((t or "").encode()).hexdigest(), i is not None, i or 0), i, len((t or "").encode()) + 1, t)
                   for i, t, *_ in rows)
    total, out, slots = sum(x[2] for x in keyed), [], {}
    for key, i, size, t in keyed:
        shard = shards * sum(x[2] for x in keyed if x[0] < key) // total
        out.append((i, size, zlib.crc32((t or "").encode()), shard))
        slots.setdefault(shard, []).append(i)
    return out, slots


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_follow_exact_bytes(documents, shards):
    rows = [(i, f"text {i % 70} " + "x" * (i * 37 % 500)) for i in range(-150, 150)] + [(i, "same" * 30) for i in range(1000, 1200)]
    want, slots = slow(rows, shards)
    got = h.shard_documents(documents(rows), shards).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == sorted(want)
    for shard, ids in slots.items():
        assert [r.doc_id for r in sorted((r for r in got if r.shard == shard), key=lambda r: r.slot)] == ids
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(len(ids)))


def test_one_text_for_all_is_still_cut(documents):
    got = h.shard_documents(documents([(i, "copy") for i in range(320)]), 16).collect()
    assert {sum(r.shard == k for r in got) for k in range(16)} == {20}


@pytest.mark.parametrize("copy", [(7, "one row " * 12), (None, "one row " * 12), (None, None)])
@pytest.mark.parametrize("carry", [(), ("source",)])
def test_one_row_repeated_is_still_cut(documents, copy, carry):
    rows = [(n, f"text {n} " * 10) for n in range(2000)] + [copy] * 1000
    docs = stored(documents(rows).repartition(5), "rows")  # `carry` reads twice
    got = h.shard_documents(docs, carry=carry).collect()
    assert len(got) == 3000 and sum(r.doc_id == copy[0] and r.size == len(copy[1] or "") + 1 for r in got) == 1000
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(16)]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    for k in range(16):
        slots = sorted(r.slot for r in got if r.shard == k)
        assert slots == list(range(len(slots)))


def test_ten_thousand_equal_rows(documents):
    got = h.shard_documents(documents([(1, "copy")] * 10_000), 16).groupBy("shard").count().collect()
    assert {r["count"] for r in got} == {625}


def test_tolerance_allows_early_splitters(documents):
    rows = [(i, f"{i}" * 10) for i in range(500)]
    got = h.shard_documents(documents(rows), 4, tolerance=200).collect()
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(4)]
    assert max(sizes) - min(sizes) <= 2 * 200 + 40


def test_edges(edge, nothing):
    rows = h.digest(h.shard_documents(edge, carry=("text",))).collect()
    assert len(rows) == edge.count()
    assert {(r["size"], r.text_crc32) for r in rows if not r.text} == {(1, 0)}
    assert h.digest(h.shard_documents(nothing)).count() == 0


def test_plan_has_no_python(documents, capsys):
    h.shard_documents(documents([(1, "a")])).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan
