import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from houselights.operators import density, keys, ranking, reshape


def test_unpivot_reverses_pivot(table):
    rows = [("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("b", "y", 4)]
    df = table(rows, "k string, v string, n bigint")
    wide = reshape.pivot_fixed(df, ["k"], "v", ["x", "y"], F.sum("n"))
    assert wide.columns == ["k", "x", "y"]
    assert sorted(map(tuple, reshape.unpivot(wide, ["k"], ["x", "y"], "v", "n").collect())) == rows


def test_pivot_fills_and_renames(table):
    df = table([("a", "Flex", 1.0)], "k string, v string, n double")
    wide = reshape.pivot_fixed(df, ["k"], "v", {"Flex": "flex", "Sub": "sub"}, F.sum("n"), fill=0.0)
    assert wide.first().asDict() == {"k": "a", "flex": 1.0, "sub": 0.0}


def test_shares_sum_to_one(table):
    df = table([("a", 1.0), ("a", 3.0), ("b", 0.0), ("b", 0.0)], "k string, v double")
    got = sorted(map(tuple, reshape.share_of_total(df, "v", ["k"], "s").collect()), key=str)
    assert [row[2] for row in got] == [0.25, 0.75, None, None]
    both = reshape.row_shares(table([("x", 1.0, 3.0), ("y", 1.0, None)], "k string, a double, b double"), ["a", "b"])
    assert sorted(map(tuple, both.collect())) == [("x", 0.25, 0.75), ("y", None, None)]


def test_total_rows_match_ungrouped_sums(table):
    df = table([("p", "1", 2, 5.0), ("p", "2", 3, 7.0), ("q", "1", 1, 1.0)], "perf string, zone string, n bigint, paid double")
    got = {(r.perf, r.zone): (r.n, r.paid) for r in reshape.with_total_rows(df, ["perf"], "zone", ["n", "paid"]).collect()}
    assert got[("p", "Total")] == (5, 12.0) and got[("q", "Total")] == (1, 1.0) and len(got) == 5


def test_months_without_data_are_zero(table):
    df = table([("2019-01-01", 4.0), ("2019-05-01", 2.0)], "month string, y double").withColumn(
        "month", F.col("month").cast("date"))
    got = [(str(r.month), r.y) for r in reshape.fill_months(df, "2019-01-01", "2019-03-01", ["y"]).orderBy("month").collect()]
    assert got == [("2019-01-01", 4.0), ("2019-02-01", 0.0), ("2019-03-01", 0.0), ("2019-05-01", 2.0)]
    series = df.withColumn("series_id", F.lit("s"))
    own = reshape.regular_monthly(series, "series_id", "month", "y").orderBy("month").collect()
    assert [r.y for r in own] == [4.0, 0.0, 0.0, 0.0, 2.0]


def test_membership(table):
    df = table([(1, "a"), (2, "b"), (None, "c")], "id bigint, v string")
    some = keys.key_set(table([(1,), (1,), (None,)], "id bigint"), "id")
    assert some.count() == 1
    assert {(r.v, r.known) for r in keys.flag_members(df, some, "id", "known").collect()} == {
        ("a", True), ("b", False), ("c", False)}
    assert [r.v for r in keys.keep_members(df, some, "id").collect()] == ["a"]
    assert {r.v for r in keys.drop_members(df, some, "id").collect()} == {"b", "c"}


def test_count_cap_is_inclusive(table):
    df = table([(1,)] * 3 + [(2,)] * 4, "id bigint")
    assert [r.id for r in keys.keys_within_count(df, "id", 3).collect()] == [1]


def test_rows_at_maximum_keep_ties(table):
    df = table([("a", 3), ("b", 5), ("c", 5), ("d", None)], "k string, v bigint")
    assert {r.k for r in keys.keep_at_max(df, "v").collect()} == {"b", "c"}
    assert df.where(F.col("v") == keys.latest(df, "v", None)).count() == 2
    assert df.where(F.col("v") == keys.latest(df, "v", 3)).count() == 1


def test_natural_join_needs_shared_names(table):
    left, right = table([(1, 2)], "a int, b int"), table([(1, 5)], "a int, z int")
    assert keys.natural_left_join(left, right).first().asDict() == {"a": 1, "b": 2, "z": 5}
    with pytest.raises(ValueError):
        keys.natural_left_join(left, table([(1,)], "q int"))


def test_top_k_breaks_ties(table):
    df = table([("a", 1), ("c", 2), ("b", 2)], "k string, v int")
    assert [r.k for r in ranking.top_k(df, 2, "v", ["k"]).collect()] == ["b", "c"]


def test_skip_first_by_key(table):
    df = table([("2019-0%d" % m, m) for m in range(1, 7)], "month string, v int")
    assert sorted(r.v for r in ranking.skip_first(df, 3, "month").collect()) == [4, 5, 6]


def test_calendar_ordinal_counts_distinct_times(table):
    times = ["2019-03-01 20:00:00", "2018-12-31 20:00:00", "2019-03-01 20:00:00", "2019-03-02 14:00:00", None]
    df = table([(t,) for t in times], "t string", ["t"])
    got = sorted((str(r.t), r.n) for r in ranking.calendar_ordinal(df, "t", "n").collect())
    assert [n for _, n in got] == [1, 2, 3]


def skewed_rows(n=4000):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        kind = rng.random()
        score = 0.5 if kind < 0.34 else (round(rng.random(), 2) if kind < 0.6 else rng.random())
        rows.append((i * 7 + rng.randrange(7), score, int(rng.random() < score)))
    rng.shuffle(rows)
    return rows


def test_global_positions_equal_a_full_sort_under_ties(table):
    rows = skewed_rows()
    df = table(rows, "id bigint, score double, buy int").repartition(7)
    ranked = ranking.global_row_number(df, "score", "id", "rn", "total")
    got = {r.id: r.rn for r in ranked.collect()}
    want = {row[0]: i + 1 for i, row in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == want
    assert {r.total for r in ranked.select("total").distinct().collect()} == {len(rows)}


def test_no_task_holds_more_than_its_share(spark, table):
    """A frequent value, a heavy tail and one far outlier."""
    rng = np.random.default_rng(4)
    values = [0.5] * 4000 + list(np.exp(rng.normal(0, 4, 4000))) + [1e300]
    df = table([(i, float(v)) for i, v in enumerate(values)], "id bigint, score double")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = df.repartitionByRange("score", "id").withColumn("part", F.spark_partition_id())
        sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * len(values) / 8
        got = {r.id: r.rn for r in ranking.global_row_number(df, "score", "id", "rn", "total").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [
        i for _, i in sorted((v, i) for i, v in enumerate(values))]


@pytest.mark.parametrize("n", [3, 5, 11, 104])
def test_global_ntile_sizes(table, n):
    df = table([(i, float(i % 4)) for i in range(n)], "id bigint, score double")
    got = [r.tile for r in ranking.global_ntile(df, 5, "score", "id", "tile").orderBy("score", "id").collect()]
    base, extra = divmod(n, 5)
    assert got == [t + 1 for t in range(5) for _ in range(base + (t < extra))]


def test_five_numbers_match_numpy(table):
    data = np.round(np.random.default_rng(1).gamma(2.0, 50.0, 1001), 2)
    df = table([(i, float(x)) for i, x in enumerate(data)] + [(5000, None)], "id bigint, x double")
    row, ids = ranking.five_numbers(df, ["x", "id"], "id").collect()
    assert ids.column == "id" and ids.max_value == 5000.0
    want = [data.min(), *np.quantile(data, [0.25, 0.5]), data.mean(), np.quantile(data, 0.75), data.max()]
    assert np.allclose(list(row)[1:], want)


def test_split_and_sample_repeat(table):
    df = table([(i,) for i in range(5000)], "id bigint")
    part = df.select(ranking.in_first_part(F.col("id")).alias("t")).where("t").count() / 5000
    assert 0.77 < part < 0.83
    first = [r.id for r in ranking.repeatable_sample(df, 10, "id").collect()]
    assert first == [r.id for r in ranking.repeatable_sample(df.repartition(9), 10, "id").collect()] and len(first) == 10


def test_density_integrates_to_one(table):
    df = table([("a", float(i)) for i in range(50)] + [("b", 1.0)], "g string, v double")
    rows = ranking.binned_density(df, ["g"], "v", 0, 50, 10).collect()
    assert abs(sum(r.density * 5 for r in rows if r.g == "a") - 1) < 1e-12


def test_bounds_extend_a_regular_series_and_cut_nothing(table):
    rows = [("a", "2019-01-01", 1.0), ("a", "2019-04-01", 2.0)]
    series = table(rows, "series_id string, month string, y double").withColumn("month", F.col("month").cast("date"))
    got = reshape.regular_monthly(series, "series_id", "month", "y", "2019-02-01", "2019-06-01").orderBy("month").collect()
    assert [r.y for r in got] == [1.0, 0.0, 0.0, 2.0, 0.0, 0.0] and str(got[0].month) == "2019-01-01"


def test_exact_split(spark):
    rows = [(n, "big" if n % 3 else ("mid" if n % 2 else None)) for n in range(3000)] + [(9000, "one"), (9001, "two"), (9002, "two")]
    df = spark.createDataFrame(rows, "id int, kind string").repartition(7)
    for share in (0.8, 0.25, 0.0, 1.0):
        got = ranking.exact_split(df, F.col("id"), ["kind"], "inside", share).collect()
        assert len(got) == len(rows)
        for kind in {k for _, k in rows}:
            mine = [r.inside for r in got if r.kind == kind]
            assert sum(mine) == math.floor(len(mine) * share + 0.5), (kind, share)
    again = ranking.exact_split(df.repartition(3), F.col("id"), ["kind"], "inside", 1.0).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}
    same = spark.createDataFrame([(1, "a")] * 10 + [(2, "a")] * 2, "id int, kind string")
    assert len({(r.id, r.inside) for r in ranking.exact_split(same, F.col("id"), ["kind"], "inside", 0.5).collect()}) == 2
    assert ranking.exact_split(same.where("id > 5"), F.col("id"), ["kind"], "inside").collect() == []


def test_kernel_density(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(50, 10, 800), "b": np.r_[rng.normal(0, 1, 300), rng.normal(20, 1, 300)], "same": np.full(20, 7.0),
              "one": np.array([2.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("none", None), (None, 1.0), (None, 3.0)]
    out = density.kernel_density(spark.createDataFrame(rows, "kind string, v double").repartition(5), ["kind"], "v").collect()
    got = {}
    for r in sorted(out, key=lambda r: r.x):
        got.setdefault(r.kind, []).append(r)
    assert set(got) == {"a", "b", "same", "one", None} and all(len(x) == 128 for x in got.values())
    for kind, vs in values.items():
        x, y, h = (np.array([getattr(r, name) for r in got[kind]]) for name in ("x", "density", "bandwidth"))
        exact = np.exp(-0.5 * ((x[:, None] - vs[None]) / h[0]) ** 2).sum(axis=1) / (len(vs) * h[0] * np.sqrt(2 * np.pi))
        assert np.abs(y - exact).max() < 0.02 * exact.max()
        assert abs(y.sum() * (x[1] - x[0]) - 1) < 0.01
    q = np.quantile(values["a"], [0.25, 0.75])
    assert got["a"][0].bandwidth == pytest.approx(0.9 * min(values["a"].std(ddof=1), (q[1] - q[0]) / 1.34) * 800 ** -0.2)
    assert got["same"][0].bandwidth == 1.0
