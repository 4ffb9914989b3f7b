"""Marketing: spend, promotions, and their relation to single-ticket revenue and web traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from houselights.functions import columns as c
from houselights.operators import ranking, reshape

# Purposes of marketing line items and their column names.
PURPOSES = {"DigitalAds": "digital_ads", "DirectMail": "direct_mail", "EmailServices": "email_services",
            "PrintMedia": "print_media", "PrintProduction": "print_production", "Promotions": "promotions",
            "RadioAndTV": "radio_and_tv"}


def promotion_conversion(promotions: DataFrame) -> DataFrame:
    """Outreach, conversions and conversion rate by promotion; no response counts as none."""
    return (promotions.fillna(0, subset=["response"]).groupBy("mt_desc")
            .agg(F.count("*").alias("number_of_outreach"), F.sum("response").alias("number_of_conversions"))
            .withColumn("conv_perc", c.ratio(F.col("number_of_conversions"), F.col("number_of_outreach"))))


def exclusive_singles(tickets: DataFrame, **dimensions: Column) -> DataFrame:
    """Single-ticket revenue of customers without any subscription, per customer and the given calendar dimensions.

    Seats collapse to one row per customer and dimension in a single pass; whether the customer holds a subscription
    is then looked up among those rows.
    """
    paid_single = c.is_single(F.col("price_type_group")) & (F.col("paid_amt") > 0)
    grouped = (tickets.where(F.col("summary_cust_id") > 0)
               .groupBy("summary_cust_id", *[column.alias(name) for name, column in dimensions.items()])
               .agg(F.sum(F.when(paid_single, F.col("paid_amt"))).alias("revenue"),
                    F.max(c.is_subscription(F.col("price_type_group"))).alias("_holds")))
    ever = F.max("_holds").over(Window.partitionBy("summary_cust_id"))
    return (grouped.withColumn("_ever", ever).where(~F.col("_ever") & F.col("revenue").isNotNull())
            .select("summary_cust_id", *dimensions, "revenue"))


def monthly_single_revenue(tickets: DataFrame, skip: int = 3) -> DataFrame:
    """Exclusive single revenue by order month, without the first months of the extract."""
    by_month = (exclusive_singles(tickets, date=c.month_start(F.col("order_dt")))
                .groupBy("date").agg(F.sum("revenue").alias("revenue")))
    return ranking.skip_first(by_month, skip, "date")


def performances_per_month(tickets: DataFrame) -> DataFrame:
    return (tickets.select("perf_dt").distinct().groupBy(c.month_start(F.col("perf_dt")).alias("date"))
            .agg(F.count("*").alias("performances")))


def expense_matrix(expenses: DataFrame) -> DataFrame:
    """Month by purpose, zero where nothing was spent."""
    dated = expenses.select(c.month_start(c.parse_date(F.col("date"))).alias("date"), "purpose",
                            F.col("exp").cast("double").alias("exp"))
    return reshape.pivot_fixed(dated, ["date"], "purpose", PURPOSES, F.sum("exp"), fill=0.0)


def spend_and_revenue(tickets: DataFrame, expenses: DataFrame) -> DataFrame:
    """One row per month that appears in revenue, spend and performances."""
    return (monthly_single_revenue(tickets).join(expense_matrix(expenses), "date")
            .join(performances_per_month(tickets), "date"))


def mix_table(tickets: DataFrame, expenses: DataFrame, web_monthly: DataFrame) -> DataFrame:
    """One row per month that appears in revenue, spend, performances and web traffic."""
    return (spend_and_revenue(tickets, expenses).join(web_monthly, "date")
            .withColumns({"print_total": F.col("print_media") + F.col("print_production"),
                          "rev_per_performance": c.ratio(F.col("revenue"), F.col("performances"))}))


def in_band(mix: DataFrame, low: float | Column, high: float | Column) -> DataFrame:
    """Months with revenue strictly inside the band; the bounds may be numbers or scalar subqueries."""
    return mix.where((F.col("revenue") < high) & (F.col("revenue") > low))


def fit_lines(mix: DataFrame) -> DataFrame:
    """Least-squares line of web sessions on each kind of spend, one row per pair of variables."""
    pairs = {
        "log_digital_ads_log_sessions": (c.log_or_null(F.col("digital_ads")), c.log_or_null(F.col("sessions"))),
        "log_print_sessions": (c.log_or_null(F.col("print_total")), F.col("sessions").cast("double")),
        "log_direct_mail_sessions": (c.log_or_null(F.col("direct_mail")), F.col("sessions").cast("double")),
        "log_radio_tv_sessions": (c.log_or_null(F.col("radio_and_tv")), F.col("sessions").cast("double")),
        "log_sessions_sessions": (c.log_or_null(F.col("sessions")), F.col("sessions").cast("double")),
    }
    points = F.explode(F.array(*[F.struct(F.lit(name).alias("pair"), x.alias("x"), y.alias("y"))
                                 for name, (x, y) in pairs.items()])).alias("p")
    return (mix.select(points).select("p.*").groupBy("pair")
            .agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
                 F.regr_r2("y", "x").alias("r2"), F.regr_count("y", "x").alias("n")))
