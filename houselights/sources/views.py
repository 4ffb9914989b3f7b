"""The library's logical tables, derived from the TPC-H-like test tables and the event stream.

A user with real extracts loads the same columns through `sources.extracts`; the reports only see DataFrames.
Every view names just the columns it needs, so scans stay pruned, and joins nothing it can do without.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from houselights.functions import columns as c
from houselights.session import use_utc

# Series by order status, price types by line number, and the labels used by the derived tables.
SERIES_BY_STATUS = {"O": "Classics", "F": "Pops"}
OTHER_SERIES = "Summer"
TYPE_BY_LINE = (c.RAW_SUBSCRIPTION, c.RAW_SUBSCRIPTION, c.RAW_FLEX, c.RAW_SINGLE, c.RAW_DISCOUNT, c.RAW_COMP, "Unsold")
PURPOSES = ("DigitalAds", "DirectMail", "EmailServices", "PrintMedia", "PrintProduction", "Promotions", "RadioAndTV")
AGE_BRACKETS = ("18-24", "25-34", "35-44", "45-54", "55-64", "65+")
DEVICES = ("desktop", "mobile", "tablet")
BROWSERS = ("Chrome", "Firefox", "Safari")

_PERF_HOUR = "INTERVAL 20 HOURS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table."""
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def tickets(spark: SparkSession, sf_dir: str, perf_from: str | None = None, perf_to: str | None = None,
            customers: DataFrame | None = None) -> DataFrame:
    """One row per seat per performance, sold or not: every stored line item is a seat.

    `customers` (one column of ids) keeps the orders of those customers, before any seat is joined.
    `perf_from`/`perf_to` (dates) also restrict the stored date column, so that they reach the Parquet scan.
    """
    items = table(spark, sf_dir, "lineitem")
    if perf_from:
        items = items.where(F.col("l_shipdate") >= F.lit(perf_from).cast("timestamp_ntz") - F.expr(_PERF_HOUR))
    if perf_to:
        items = items.where(F.col("l_shipdate") <= F.lit(perf_to).cast("timestamp_ntz"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    if customers is not None:
        orders = orders.join(customers, orders["o_custkey"] == customers[customers.columns[0]], "left_semi")

    cid, line = F.col("o_custkey"), F.col("l_linenumber")
    perf_dt = F.col("l_shipdate") + F.expr(_PERF_HOUR)
    fy = F.year(F.add_months("l_shipdate", 6))
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # A customer stays away in some years; their seats are then unsold.
    sold = (line != 7) & (fy >= 1995 + cid % 7) & ((cid + fy) % 3 != 0)

    plan_holder = (cid % 2 == 1) & (fy >= 1996 + cid % 7)
    price_type = _pick(TYPE_BY_LINE, F.when(~sold, 6).when((line <= 3) & ~plan_holder, 3).otherwise(line - 1))
    series = F.lit(OTHER_SERIES)
    for status, name in SERIES_BY_STATUS.items():
        series = F.when(F.col("o_orderstatus") == status, name).otherwise(series)
    zone = F.col("l_suppkey") % 6
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 10)
    return joined.select(
        F.when(sold, cid).when(F.col("l_suppkey") % 2 == 1, 0).cast("bigint").alias("summary_cust_id"),
        F.concat(c.season_label(fy), F.lit(" "), series).alias("season_desc"),
        price_type.alias("price_type_group"),
        F.when(sold & (line < 6), cents / F.lit(100.0)).otherwise(F.lit(0.0)).alias("paid_amt"),
        F.concat(F.lit("Price "), F.when(zone == 0, "B").otherwise(zone.cast("string")), F.lit(" - "),
                 F.col("l_linestatus")).alias("zone_desc"),
        perf_dt.alias("perf_dt"),
        F.col("o_orderdate").alias("order_dt"),
        F.concat(F.lit("S"), (F.col("l_partkey") % 12).cast("string")).alias("section"),
        (F.col("l_partkey") % 40).cast("string").alias("row"),
        line.cast("string").alias("seat"),
        F.when(sold, F.when(F.col("l_returnflag") == "R", "Not Attended").otherwise("Attended"))
        .alias("attended"),
    )


def donations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gift for every stored order."""
    date, cid = F.col("o_orderdate"), F.col("o_custkey")
    fy = c.fiscal_year(date)
    return (table(spark, sf_dir, "orders")
            .select(cid.alias("summary_cust_id"),
                    (F.floor(F.col("o_totalprice") * 100 / F.pow(F.lit(10.0), cid % 4)) / F.lit(100.0))
                    .alias("gift_plus_pledge"),
                    fy.alias("cont_fy"),
                    F.concat(c.season_label(fy), F.lit(" Annual")).alias("campaign"),
                    F.lit("Annual Fund").alias("fund_desc")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_no"), F.col("c_name").alias("display_name"))


def birth_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_no"),
        F.when(F.col("c_nationkey") == 0, 0).otherwise(1915 + F.col("c_custkey") % 90).cast("int").alias("key_value"))


def performances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance date and programme name; distinct dates of the ticket table."""
    day = F.col("l_shipdate")
    return (table(spark, sf_dir, "lineitem").select("l_shipdate").distinct()
            .select((day + F.expr(_PERF_HOUR)).alias("perf_dt"),
                    F.concat(F.lit("Program "), F.lpad((F.dayofyear(day) % 15).cast("string"), 2, "0")).alias("name")))


# Standard price by zone on Thursday, Friday and Saturday.
LIST_PRICES = {
    "Price 1": (121, 121, 131), "Price 2": (91, 91, 101), "Price 3": (71, 71, 81), "Price 4": (41, 41, 51),
    "Price 5": (25, 25, 35), "Price B": (199, 199, 209),
}


def list_prices(spark: SparkSession) -> DataFrame:
    """Standard price by zone and weekday (18 inline rows, so the optimiser knows their size)."""
    rows = ", ".join(f"('{zone}', '{day}', {price}D)" for zone, prices in LIST_PRICES.items()
                     for day, price in zip(("Thursday", "Friday", "Saturday"), prices))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(price_zone, day_of_week, standard_price)")


def expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marketing line items: date as text, amount, purpose."""
    return table(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "M/d/yyyy").alias("date"),
        (F.floor(F.col("l_extendedprice") * F.col("l_tax")) / F.lit(100.0)).alias("exp"),
        _pick(PURPOSES, F.col("l_suppkey") % 7).alias("purpose"))


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("M"), (F.col("event_id") % 7).cast("string")).alias("mt_desc"),
        F.when(kind == "purchase", 1).when(kind != "error", 0).alias("response"))


def ab_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per mailed customer: did an order of the test variant convert?"""
    mailed = F.col("o_custkey") % 4 != 0
    return table(spark, sf_dir, "orders").select(
        F.when(mailed, "receive").otherwise("no_receive").alias("variant"),
        F.when(F.when(mailed, F.col("o_totalprice") > 420000).otherwise(F.col("o_totalprice") > 425000), 1)
        .otherwise(0).alias("converted"))


def web_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with the dimensions of the web reports.

    `report_date` spreads the 30 days over 60 months (two months a day), so that monthly reports and their joins
    with ticket months have something to show; `ts` keeps the true time for sessions.
    """
    hit = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.datediff(F.col("ts"), F.lit("2024-01-01"))
    month_offset = day * 2 + F.when(F.hour("ts") >= 12, 1).otherwise(0)
    return hit.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.to_date("ts").alias("date"),
        F.add_months(F.lit("1996-07-01").cast("date"), month_offset).alias("report_date"),
        F.col("event_type").alias("channel"),
        F.concat(F.lit("/page/"), k.cast("string")).alias("page"),
        F.when(k % 2 == 0, F.concat(F.lit("Group "), F.lpad(k.cast("string"), 2, "0"))).alias("ad_group"),
        _pick(AGE_BRACKETS, F.col("user_id") % 6).alias("age_bracket"),
        _pick(DEVICES, F.col("user_id") % 3).alias("device"))


def viewers(spark: SparkSession, sf_dir: str, holdout: bool = False) -> DataFrame:
    """One row per viewer with purchase outcome and predictors; odd customers train, even ones are held out."""
    cid = F.col("c_custkey")
    activity = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("totvids"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("elecvids"))
    return (table(spark, sf_dir, "customer").where(cid % 2 == (0 if holdout else 1))
            .join(activity, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(cid.alias("viewer_id"),
                    F.when(F.col("c_acctbal") + 60 * (cid % 50) > 6000, 1).otherwise(0).alias("buy"),
                    F.when(cid % 5 < 2, 1).otherwise(0).alias("view"),
                    F.coalesce("totvids", F.lit(0)).cast("double").alias("totvids"),
                    F.coalesce("elecvids", F.lit(0)).cast("double").alias("elecvids"),
                    _pick(BROWSERS, F.col("c_nationkey") % 3).alias("browser"),
                    F.when(F.col("c_nationkey") % 2 == 0, "Desktop").otherwise("Mobile").alias("device"),
                    (18 + cid % 50).cast("double").alias("age"),
                    F.when(cid % 3 == 0, "F").otherwise("M").alias("gender")))


def performance_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per performance: revenue, goal, and the predictors of the revenue regression. Flex and subscription counts
    are those of the same day a year before, zero where there was no performance."""
    flex = F.count_if(F.col("price_type_group") == c.RAW_FLEX)
    subs = F.count_if(F.col("price_type_group") == c.RAW_SUBSCRIPTION)
    now = tickets(spark, sf_dir).groupBy("perf_dt").agg(
        F.sum("paid_amt").alias("revenue"), (F.count("*") * 25.0).alias("goal"),
        flex.cast("double").alias("_flex"), subs.cast("double").alias("_subs")).withColumn("_day", F.to_date("perf_dt"))
    before = now.select(F.col("_day").alias("_then"), F.col("_flex").alias("_flex_then"), F.col("_subs").alias("_subs_then"))
    rows = now.join(before, F.add_months("_day", -12) == F.col("_then"), "left")
    day = F.dayofyear("perf_dt")
    return rows.select(
        "perf_dt", "revenue", "goal", F.coalesce("_flex_then", F.lit(0.0)).alias("flex_sold"),
        F.coalesce("_subs_then", F.lit(0.0)).alias("lag_subs_1yr"), c.fiscal_year(F.col("perf_dt")).alias("fy"),
        F.month("perf_dt").cast("string").alias("month"), (day % 4).cast("string").alias("composer_tier"),
        (F.dayofmonth("perf_dt") % 3).cast("string").alias("guest_artist_tier"),
        F.when(day % 5 == 0, 1.0).otherwise(0.0).alias("guest_violin"),
        F.when(day % 7 == 0, 1.0).otherwise(0.0).alias("guest_piano"),
        F.when(day % 11 == 0, 1.0).otherwise(0.0).alias("opera"), (day % 9).cast("double").alias("number_of_words"),
        F.when(day % 6 == 0, 1.0).otherwise(0.0).alias("word_plays"),
        F.when(day % 13 == 0, 1.0).otherwise(0.0).alias("connections"))
