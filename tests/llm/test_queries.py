"""The registered queries over whole tables against plain versions of what they return."""

import hashlib
import math

import pytest

from houselights.llm import personal_data, queries, token_counts
from houselights.llm.common import table
from test_line_rules import slow as slow_counts
from test_personal_data import slow as slow_spans
from test_simhash_index import slow_components, slow_fingerprint
from test_suffix_dedup import slow as slow_removal

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF_DIR, "documents").collect()}


def rows(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, SF_DIR).collect()}


def test_op1(spark, texts):
    got = rows(spark, "op1_line_rules")
    assert {i: tuple(r[1:7]) for i, r in got.items()} == {i: slow_counts(t) for i, t in texts.items()}
    assert not any(r.kept and r.base_failed for r in got.values())


def test_op1_keeps_what_the_labels_call_good(spark):
    got = rows(spark, "op1_line_rules")
    labels = [(got[r.doc_id], r.quality) for r in table(spark, SF_DIR, "labels").collect()]
    judged = [(r.kept, quality == 1) for r, quality in labels if not r.base_failed]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_op2(spark, texts):
    got, ids = rows(spark, "op2_gray_simhash"), sorted(texts)
    marks = [slow_fingerprint(texts[i]) for i in ids]
    assert [got[i].fingerprint for i in ids] == [format(m, "016x") for m in marks]
    assert [got[i].component_id for i in ids] == [ids[r] for r in slow_components(marks)]


def test_op3(spark, texts):
    got = rows(spark, "op3_suffix_dedup")
    assert sorted(tuple(r) for r in got.values()) == sorted(slow_removal(list(texts.items()), 200))


def test_op6(spark, texts):
    out = queries.QUERIES["op6_temperature_mixing"](spark, SF_DIR).collect()
    uses = [(r.doc_id, r.epoch) for r in out]
    assert len(uses) == len(set(uses)) and {i for i, e in uses if e == 0} == set(texts) and {e for _, e in uses} <= {0, 1}
    assert all(r.n_tokens == len(texts[r.doc_id].encode().split()) for r in out)


def test_op7(spark, texts):
    score = {p: -math.log(r + token_counts.SHIFT) for p, r in token_counts.read_ranks().items()}
    known = {}

    def pieces(word):
        if word not in known:
            best = [(0.0, 0)]
            for end in range(1, len(word) + 1):
                best.append(max((best[a][0] + score[word[a:end]], best[a][1] - 1) for a in range(end) if word[a:end] in score))
            known[word] = -best[-1][1]
        return known[word]

    got = rows(spark, "op7_trie_token_counts")
    for i, text in texts.items():
        words = token_counts.PRE_TOKEN.findall(text.encode())
        assert tuple(got[i])[1:] == (len(text.encode()), len(words), sum(map(pieces, words)))


def test_op9(spark, texts):
    got = rows(spark, "op9_personal_data")
    for i, text in texts.items():
        base = slow_spans(text)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert tuple(got[i])[1:5] == tuple(sum(k == kind for k, *_ in base) for kind in personal_data.KINDS)
        assert set(said.split(",")) - {""} <= set(got[i].spans.split(","))


def test_op10(spark):
    """On the next larger tables: the smallest hold fewer than seventy labelled rows to learn from."""
    sf_dir = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES["op10_subword_quality"](spark, sf_dir).collect()}
    held = [(got[r.doc_id].predicted, r.quality) for r in table(spark, sf_dir, "labels").collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 0
