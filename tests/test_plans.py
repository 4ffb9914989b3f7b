"""Physical plans: what is read, what is shuffled, and what never appears."""

import re

import pytest
from pyspark.sql import functions as F

from houselights import catalog
from houselights.plans import audience
from houselights.sources import views

LAZY = sorted(set(catalog.QUERIES) - {"season_store", "extract_scan", "report_sheets", "birth_year_extract", "donation_csv",
                                       "grouped_report_sheets", "performance_names"})


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_row_at_a_time_python(spark, sf_dir, name):
    text = plan_text(catalog.QUERIES[name](spark, sf_dir))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow",
                 "FlatMapGroupsInPandas", "FlatMapGroupsInArrow"):
        assert node not in text


def test_one_concert_reads_one_day(spark, sf_dir):
    day = audience.one_day(views.tickets(spark, sf_dir, "2001-04-26", "2001-04-27"), "2001-04-26")
    text = plan_text(day)
    assert "GreaterThanOrEqual(l_shipdate,2001-04-25T04:00), LessThanOrEqual(l_shipda" in text
    wide = audience.one_day(views.tickets(spark, sf_dir), "2001-04-26")
    assert day.count() == wide.count() > 0


def test_only_needed_columns_are_read(spark, sf_dir):
    text = plan_text(catalog.QUERIES["dow_revenue"](spark, sf_dir))
    names = {name.split("#")[0] for name in ",".join(re.findall(r"FileScan parquet \[([^\]]*)\]", text)).split(",")}
    assert names <= {"l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_shipdate", "o_orderkey", "o_custkey"}


@pytest.mark.parametrize("name", ["performance_summary", "audience_mix", "subscriber_tenure", "monthly_single_revenue",
                                  "zone_percent_sold", "revenue_per_performance"])
def test_seats_are_scanned_once(spark, sf_dir, name):
    text = plan_text(catalog.QUERIES[name](spark, sf_dir))
    assert text.count("FileScan parquet [l_orderkey") == 1


def shuffled_rows(df):
    """Rows that each shuffle of a query wrote when it ran."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                out.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_seats_within_cap_groups_once_and_moves_no_unsold_seats(spark, table, tmp_path):
    # Customers 4 and 5 come in fiscal year 2001, customer 6 stays away; even suppliers' unsold seats have no customer at all.
    orders = {1: (4, 40), 2: (5, 41), 3: (6, 300)}
    day = "2000-08-01 00:00:00"
    table([(key, cid, "O", day) for key, (cid, _) in orders.items()],
          "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate string", ["o_orderdate"]
          ).write.parquet(f"{tmp_path}/orders.parquet")
    table([(key, 1, i, 1, 90.0, 0.0, "A", "O", day) for key, (_, n) in orders.items() for i in range(n)],
          "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_extendedprice double, l_discount double, "
          "l_returnflag string, l_linestatus string, l_shipdate string", ["l_shipdate"]
          ).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["seats_within_cap"](spark, str(tmp_path))
    text = plan_text(got)
    assert "LeftSemi" not in text and text.count("FileScan parquet [l_orderkey") == 1
    assert [tuple(r) for r in got.collect()] == [(4, 40)]


def test_seat_finder_moves_no_unsold_seats(spark, tickets, table):
    day = "2019-01-31 20:00:00"
    stored = tickets([(1, "Flex", 9, day)] * 3 + [(2, "Flex", 9, day)] * 4 + [(3, "Unsold", 0, day)] * 500)
    # As in the views the customer of an unsold seat is 0, by a condition.
    seats = stored.withColumn("summary_cust_id", F.when(F.col("price_type_group") != "Unsold", F.col("summary_cust_id"))
                              .when(F.col("row") == "1", 0).cast("bigint"))
    names = table([(1, "Ann"), (2, "Bob")], "customer_no bigint, display_name string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = audience.seat_finder(seats, seats, names, audience.AudienceRules(2019, 3))
        assert max(shuffled_rows(got)) < 100
        assert [r.summary_cust_id for r in got.collect()] == [1, 1, 1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_views_keep_every_stored_row(spark, sf_dir):
    stored = {name: views.table(spark, sf_dir, name).count() for name in ("lineitem", "orders", "events", "customer")}
    assert views.tickets(spark, sf_dir).count() == views.expenses(spark, sf_dir).count() == stored["lineitem"]
    assert views.donations(spark, sf_dir).count() == views.ab_outcomes(spark, sf_dir).count() == stored["orders"]
    assert views.web_hits(spark, sf_dir).count() == views.promotions(spark, sf_dir).count() == stored["events"]
    assert views.customers(spark, sf_dir).count() == views.birth_years(spark, sf_dir).count() == stored["customer"]
