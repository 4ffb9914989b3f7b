"""Mergeable sets of ids, and item sets from bitmaps, against counting."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from houselights.models import itemsets
from houselights.operators import bitmaps


@pytest.fixture
def visits(spark):
    """20,000 ids in block 0 and few in far ones; key 'hot' holds a third of all rows."""
    rng = random.Random(5)
    rows = [("hot", day, rng.randrange(20_000)) for day in range(3) for _ in range(9000)]
    rows += [(k, day, rng.choice([-5, 0, 1, 32768, 32769, 10**12 + rng.randrange(9), rng.randrange(10**9)]))
             for k in "abc" for day in range(3) for _ in range(60)]
    rows += [("a", 0, None), (None, 1, 7), (None, 2, 7)] + [("b", 1, 42)] * 500
    return rows, spark.createDataFrame(rows, "k string, day int, who bigint")


def test_counts_of_any_range_are_exact(visits):
    rows, df = visits
    rolled = bitmaps.roll_up(df, "who", "day", "k").cache()
    assert rolled.where("bits is not null").count() == 3
    assert rolled.where("(spots is null) = (bits is null)").count() == 0
    for days in ([0], [1, 2], [0, 1, 2]):
        want = {}
        for k, day, who in rows:
            if day in days and who is not None:
                want.setdefault(k, set()).add(who)
        got = bitmaps.unique_counts(rolled.where(F.col("day").isin(days)), "k").collect()
        assert {r.k: r.n for r in got} == {k: len(ids) for k, ids in want.items()}


def test_one_day_can_be_appended(visits):
    _, df = visits
    parts = [bitmaps.roll_up(df.where(df.day == n), "who", "day", "k") for n in range(3)]
    appended = parts[0].unionByName(parts[1]).unionByName(parts[2])
    whole = bitmaps.roll_up(df, "who", "day", "k")
    keys = lambda rolled: {(r.k, r.n) for r in bitmaps.unique_counts(rolled, "k").collect()}
    assert keys(appended) == keys(whole)


def test_empty_roll_up(spark):
    none = spark.createDataFrame([], "k string, who bigint")
    assert bitmaps.unique_counts(bitmaps.roll_up(none, "who", "k"), "k").count() == 0


@pytest.fixture
def carts(spark):
    rng = random.Random(9)
    rows = [[rng.choice("abcdef") for _ in range(rng.randrange(0, 5))] for _ in range(300)] + [["a", None], None]
    return rows, spark.createDataFrame([(x,) for x in rows], "items array<string>").repartition(4)


@pytest.mark.parametrize("support", [0.0, 0.1])
def test_sets_match_counting(carts, support):
    rows, df = carts
    sets = [set(x or ()) - {None} for x in rows]
    want = {}
    for size in (2, 3, 4):
        for combo in itertools.combinations("abcdef", size):
            n = sum(set(combo) <= x for x in sets)
            if n and n / len(rows) >= support:
                want[combo] = n
    got = itemsets.itemsets(df, support, 2, 4).collect()
    assert {tuple(r["items"]): r.freq for r in got} == want and len(got) == len(want)
    assert all(abs(r.support - r.freq / len(rows)) < 1e-12 for r in got)


def test_rules_match_counting(carts):
    rows, df = carts
    sets = [set(x or ()) - {None} for x in rows]
    n = lambda *items: sum(set(items) <= x for x in sets)
    want = {}
    for size in (2, 3):
        for combo in itertools.combinations("abcdef", size):
            for c in combo:
                left = tuple(x for x in combo if x != c)
                if n(*combo) and n(*combo) / n(*left) >= 0.3:
                    want["|".join(left), c] = (n(*combo) / n(*left), n(*combo) / n(*left) / (n(c) / len(rows)))
    got = {(r.antecedent, r.consequent): (r.confidence, r.lift) for r in itemsets.rules(df, 0.0, 0.3, 3).collect()}
    assert got.keys() == want.keys()
    assert all(a == pytest.approx(b) for a, b in ((got[k], want[k]) for k in want))


def test_no_baskets(spark):
    none = spark.createDataFrame([], "items array<string>")
    assert itemsets.itemsets(none).count() == 0 and itemsets.rules(none).count() == 0
    with pytest.raises(ValueError):
        itemsets.itemsets(none, least_items=4, most_items=3)


def test_levels_never_read_the_baskets(carts):
    text = itemsets.itemsets(carts[1], 0.1, 2, 3)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
