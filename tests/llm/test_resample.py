"""Importance resampling: weights and draw against a plain version, and the radix sort by itself."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from houselights.llm import resample as r
from houselights.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return WORD.findall(low)


def plain_features(text, runs):
    words = plain_words(text)
    return [zlib.crc32(" ".join(words[i:i + k]).encode()) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


def slow(rows, target, runs=1, buckets=10_000, min_words=20, percent=10):
    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for x in plain_features(text, runs):
            s[x % buckets] += 1
    for text in target:
        for x in plain_features(text, runs):
            t[x % buckets] += 1
    whole, wanted = float(sum(s)), float(sum(t))
    gain = [math.floor(1000 * math.log((b + 1.0) * (whole + buckets) / ((a + 1.0) * (wanted + buckets)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text in rows:
        found = [gain[x % buckets] for x in plain_features(text, runs)]
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = sum(found) + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([doc_id, len(found), sum(found), score, None, len(plain_words(text))])
    fit = sorted((x for x in out if x[5] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for n, x in enumerate(fit[:percent * len(fit) // 100]):
        x[4] = n + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


@pytest.mark.parametrize("runs", [2])
def test_whole_tables(spark, runs):
    docs, target = (table(spark, "/root/testdata/sf0.001", x) for x in ("documents", "benchmark"))
    got = sorted(map(tuple, r.resample(docs, target, runs=runs).collect()), key=repr)
    want = slow([(x.doc_id, x.text) for x in docs.collect()], [x.text for x in target.collect()], runs)
    assert got == want and sum(x[4] is not None for x in got) > 10


def test_odd_rows(spark, edge, nothing, documents):
    target = documents([(1, "Quick brown dogs, word12 word13"), (2, None), (None, "")])
    rows = [(x.doc_id, x.text) for x in edge.collect()]
    got = sorted(map(tuple, r.resample(edge, target, 50, 15).collect()), key=repr)
    assert got == slow(rows, [x.text for x in target.collect()], percent=50, min_words=15)
    assert r.resample(nothing, target).collect() == []
    assert sorted(map(tuple, r.resample(edge, nothing).collect()), key=repr) == slow(rows, [])


def test_extreme_ids(documents, nothing):
    rows = [(i, "some words that repeat " * 6) for i in (-(1 << 63), (1 << 63) - 1, 0, -1, 1, None, None)]
    got = sorted(map(tuple, r.resample(documents(rows), nothing, percent=100).collect()), key=repr)
    assert got == slow(rows, [], percent=100) and sorted(x[4] for x in got) == list(range(1, 8))


@pytest.mark.parametrize("high_bits,low_bits,digit_bits,block_bits", [
    (0, 0, 8, 12), (9, 0, 8, 12), (5, 11, 5, 4), (2, 64, 16, 5)])
def test_radix_sort(spark, high_bits, low_bits, digit_bits, block_bits):
    rng = random.Random(high_bits * 100 + low_bits)
    # A third of all rows share one key.
    keys = [(rng.getrandbits(high_bits) if high_bits else 0, rng.getrandbits(low_bits) if low_bits else 0) for _ in range(400)]
    keys += [keys[0]] * 200
    signed = [(n, a, b - (1 << 64) if b >> 63 else b) for n, (a, b) in enumerate(keys)]
    rows = spark.createDataFrame(signed, "n int, a bigint, b bigint").repartition(5)
    got = r.radix_sort(rows, F.col("a"), F.col("b"), high_bits, low_bits, digit_bits, block_bits).collect()
    assert sorted(x["n"] for x in got) == list(range(600))
    if high_bits + low_bits:
        assert sorted(x["at"] for x in got) == list(range(600))
        assert [keys[x["n"]] for x in sorted(got, key=lambda x: x["at"])] == sorted(keys)


def test_a_row_that_makes_up_a_third(spark, documents):
    rows = [(n, f"text {n} of many words " + "more " * 20) for n in range(300)] + [(7, "twenty words or more " * 9)] * 150
    rows += [(None, "no id but many words " * 9)] * 100
    target = documents([(1, "twenty words")])
    got = sorted(map(tuple, r.resample(documents(rows).repartition(9), target).collect()), key=repr)
    assert got == slow(rows, ["twenty words"])
