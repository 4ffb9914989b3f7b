import functools
import math
import random

import pytest

from houselights.llm import token_counts as t


@pytest.fixture(scope="module")
def ranks():
    return t.read_ranks()


def slow(word, score):
    @functools.cache
    def best(end):
        if not end:
            return 0.0, 0
        return max((best(start)[0] + score[word[start:end]], best(start)[1] - 1)
                   for start in range(end) if word[start:end] in score)
    return -best(len(word))[1]


def test_counts_match_the_plain_dynamic_programme(ranks):
    model, rng = t.Unigram(ranks), random.Random(1)
    words = [b"", b" the", b" there", b" thereafter", b"there", "größer".encode(), b"\n\n  \n"]
    words += [bytes(rng.choice(b" abcdetion") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    counts = model.counts(set(words))
    assert counts == {w: slow(w, model.score) for w in set(words)}


def test_shared_prefixes_are_scored_once():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 301}
    model, calls = t.Unigram(ranks), []
    model.score = type("Seen", (dict,), {"get": lambda self, k: calls.append(k) or dict.get(self, k)})(model.score)
    model.counts([b"abcx", b"abcy", b"abc"])
    assert sum(k == b"ab" for k in calls) == 1


def test_ties_take_fewest_pieces():
    ranks = {bytes([b]): b for b in range(256)}
    model = t.Unigram(ranks)
    model.score = dict.fromkeys(ranks, -1.0) | {b"ab": -2.0}
    model.longest = 2
    assert model.counts([b"ab"]) == {b"ab": 1}


def test_pre_tokens_are_the_text():
    text = "  a b\n\nc  d\x0b ".encode()
    assert b"".join(t.PRE_TOKEN.findall(text)) == text


def test_documents_match_brute_force(documents, ranks, monkeypatch):
    monkeypatch.setattr(t, "SLICE_BYTES", 50)
    score = {p: -math.log(r + t.SHIFT) for p, r in ranks.items()}
    rows = [(n, " ".join(["the", "house", "éa", "tion"][k % 4] * (k % 3 + 1) for k in range(n))) for n in range(25)]
    got = {r.doc_id: r for r in t.count_tokens(documents(rows)).collect()}
    for n, text in rows:
        pieces = t.PRE_TOKEN.findall(text.encode())
        assert tuple(got[n])[1:] == (len(text.encode()), len(pieces), sum(slow(x, score) for x in pieces))


def test_vocabulary_needs_all_bytes():
    with pytest.raises(ValueError):
        t.Unigram({b"a": 0})


def test_edges(edge, nothing):
    rows = t.count_tokens(edge).collect()
    assert len(rows) == edge.count()
    assert {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (3, 4)} == {(0, 0)}
    assert t.count_tokens(nothing).count() == 0
