import math
import random

import pytest

from houselights.llm import mixing as m


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(n, "w " * rng.randint(0, 60), "hot" if n % 3 == 0 else f"s{n % 7}") for n in range(1500)]


def test_repetition_limit_and_entropy():
    totals = [1000.0, 200.0, 50.0, 0.0]
    a = m.exponent_for(totals, m.Target(max_repeats=3))
    shares = m.weights(totals, a)
    assert math.isclose(max(m.epochs(totals, shares, m.smallest_budget(totals, shares))[:3]), 3, rel_tol=1e-9)
    a = m.exponent_for(totals, m.Target(entropy_share=0.9))
    assert math.isclose(m.entropy(m.weights(totals, a)), 0.9 * math.log(3), rel_tol=1e-9)
    assert m.exponent_for(totals, m.Target(max_repeats=1000)) == 0.0
    assert m.exponent_for(totals, m.Target(entropy_share=0.0)) == 1.0
    with pytest.raises(ValueError):
        m.Target()
    with pytest.raises(ValueError):
        m.Target(0.5, 2)


@pytest.mark.parametrize("budget", [None, 9000.0, 200_000.0])
def test_budgets_are_met(documents, rows, budget):
    docs, target = documents(rows), m.Target(entropy_share=0.98)
    mixture, _ = m.fit(docs, target, budget)
    got = m.plan_rows(docs, target, budget).collect()
    size = {n: len(t.split()) for n, t, _ in rows}
    for source, total, weight, used in mixture.rows:
        own = [r for r in got if r.source == source]
        want = weight * mixture.budget
        assert abs(sum(r.n_tokens for r in own) - want) <= 60
        for epoch in range(int(used)):
            assert sorted(r.doc_id for r in own if r.epoch == epoch) == sorted(n for n, _, s in rows if s == source)
        last = [r.doc_id for r in own if r.epoch == int(used)]
        assert len(last) == len(set(last))
    assert all(r.n_tokens == size[r.doc_id] and 0 <= r.mix_order <= 1 for r in got)


def test_smallest_budget_keeps_every_document(documents, rows):
    got = m.plan_rows(documents(rows), m.Target(max_repeats=2)).collect()
    uses = {n: 0 for n, *_ in rows}
    for r in got:
        uses[r.doc_id] += 1
    assert set(uses.values()) <= {1, 2}


def test_stretches_hold_the_weights(documents, rows):
    docs, target = documents(rows), m.Target(max_repeats=2)
    mixture, _ = m.fit(docs, target)
    got = sorted(m.plan_rows(docs, target).collect(), key=lambda r: r.mix_order)
    part = got[len(got) // 4:3 * len(got) // 4]
    tokens = sum(r.n_tokens for r in part)
    for source, _, weight, _ in mixture.rows:
        assert abs(sum(r.n_tokens for r in part if r.source == source) / tokens - weight) < 0.06


def test_epochs_are_permutations_of_their_own(documents):
    docs = documents([(n, "a b c", "x" if n < 50 else "y") for n in range(600)])
    got = m.plan_rows(docs, m.Target(max_repeats=4)).where("source = 'x'").orderBy("mix_order").collect()
    first = [r.doc_id for r in got if r.epoch == 0]
    second = [r.doc_id for r in got if r.epoch == 1]
    assert sorted(first) == sorted(second) and first != second


def test_edges(edge, nothing, documents):
    target = m.Target(max_repeats=2)
    out = m.mixed(edge, target)
    assert out.schema == edge.schema
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in edge.select("doc_id").collect()}
    assert m.mixed(nothing, target).count() == m.plan_rows(nothing, target).count() == 0
    assert m.plan_rows(documents([(1, None, "a"), (2, "", None)]), target).count() == 2


def test_too_many_sources(documents, monkeypatch):
    monkeypatch.setattr(m, "MAX_SOURCES", 2)
    with pytest.raises(ValueError):
        m.fit(documents([(n, "a", f"s{n}") for n in range(3)]), m.Target(max_repeats=2))
