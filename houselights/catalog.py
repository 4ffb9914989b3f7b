"""Registered queries: each report and operator over the test tables, with its result in comparable types."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from houselights import schemas
from houselights.functions import columns as c
from houselights.models import abtest, basket, itemsets, orders, regression, series, smoothing
from houselights.models import decomposition as decomposition_
from houselights.operators import bitmaps, density, keys, ranking, reshape
from houselights.plans import audience, concert, donors, marketing, revenue, web, weekday
from houselights.session import materialise, scratch_folder
from houselights.sources import extracts, views

THIS_FY = 2001
AS_OF = "2001-06-30"
AS_OF_YEAR = 2001
CUTOFF = "2000-12-31"
CONCERT = "2001-04-26"
RULES = audience.AudienceRules(this_fy=THIS_FY, seat_cap=40)
POPS = audience.series_seasons(THIS_FY, "Pops")
CLASSICS = audience.series_seasons(THIS_FY, "Classics")
FIRST_MONTH, LAST_MONTH = "1995-01-01", "2001-12-01"
SERIES_FIRST, SERIES_LAST = "1996-07-01", "2001-06-01"
SEASONS = revenue.season_labels(1997, 2001)
HALF_DAY = 12 * 3600
SINGLE_CAP = 1500.0

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
COVERS: dict[str, str] = {}


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as bigint, dates and timestamps as ISO text."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            col = F.round(col.cast("double"), digits)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DateType):
            col = col.cast("string")
        out.append(col.alias(field.name))
    return df.select(*out)


def query(covers: str, digits: int = 6) -> Callable[[Query], Query]:
    """Register a query under its function name, noting the inventory lines it shows."""
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(spark, sf_dir), digits)
        QUERIES[fn.__name__] = run
        COVERS[fn.__name__] = covers
        return run
    return register


T_, D_ = views.tickets, views.donations


# --- weekday and zone ----------------------------------------------------------------------------------------


@query("Q0 Q1 A1 P7 F7")
def dow_revenue(s, d):
    return weekday.day_order(weekday.revenue(T_(s, d)))


@query("Q2 U4 A2")
def dow_sold_attended(s, d):
    return weekday.sold_and_attended(T_(s, d))


@query("Q3")
def dow_comps(s, d):
    return weekday.comps(T_(s, d))


@query("Q3")
def dow_unsold(s, d):
    return weekday.unsold_seats(T_(s, d))


@query("Q4 A4")
def dow_subscribers(s, d):
    return weekday.subscribers(T_(s, d))


@query("Q5 J1 B6 P18")
def dow_donors(s, d):
    return weekday.donors(T_(s, d), D_(s, d))


@query("Q5")
def dow_donors_without_h(s, d):
    return weekday.donors(T_(s, d), D_(s, d), list("ABCDEFG"))


@query("Q5")
def dow_donors_major(s, d):
    return weekday.donors(T_(s, d), D_(s, d), weekday.MAJOR_BANDS)


@query("Q6 B2 F1")
def zone_revenue(s, d):
    return weekday.zone_revenue(T_(s, d))


@query("Q7")
def zone_sold(s, d):
    return weekday.zone_sold(T_(s, d))


@query("Q8 J7")
def zone_percent_sold(s, d):
    return weekday.zone_percent_sold(T_(s, d))


@query("Q9 A5")
def zone_avg_price(s, d):
    return weekday.zone_average_price(T_(s, d))


@query("Q9")
def zone_avg_price_singles(s, d):
    return weekday.zone_average_price(T_(s, d), singles_only=True)


@query("Q10")
def zone_comp_attendance(s, d):
    return weekday.zone_comps(T_(s, d))


@query("Q11 B9")
def zone_attendance_rate(s, d):
    return weekday.zone_attendance_rate(T_(s, d))


@query("Q12")
def zone_subscribers(s, d):
    return weekday.zone_subscribers(T_(s, d), "Subscription")


@query("Q12")
def zone_flex_subscribers(s, d):
    return weekday.zone_subscribers(T_(s, d), "Flex")


@query("Q12 A4")
def zone_uniques_over_ranges(s, d):
    """Unique customers of three overlapping ranges from one stored roll-up."""
    rolled = materialise(weekday.customer_roll_up(T_(s, d)))
    ranges = [("1996-01-01", "1996-12-31"), ("1996-07-01", "1997-06-30"), (None, None)]
    return functools.reduce(DataFrame.unionByName, (
        weekday.zone_uniques(rolled, first, last).withColumns({"first": F.lit(first), "last": F.lit(last)})
        for first, last in ranges))


@query("Q13")
def zone_major_donors(s, d):
    return weekday.zone_major_donors(T_(s, d), D_(s, d))


@query("Q14 U3 S13 J9 P18 T1")
def monthly_dow_tix(s, d):
    return weekday.monthly_wide(T_(s, d), "tix_sold", FIRST_MONTH, LAST_MONTH)


@query("Q14 F9")
def monthly_dow_revenue(s, d):
    return weekday.monthly_wide(T_(s, d), "rev_per_perf", FIRST_MONTH, LAST_MONTH)


@query("Q15 B1")
def fy_dow_revenue(s, d):
    return weekday.revenue_by_fiscal_year(T_(s, d))


@query("Q16 A7 A8")
def subscriber_tenure(s, d):
    return weekday.subscriber_tenure(T_(s, d), THIS_FY)


@query("Q17 S12 J8")
def percent_potential_revenue(s, d):
    return weekday.percent_of_potential_revenue(T_(s, d), views.list_prices(s))


@query("Q18 W1 B13")
def sell_type_mix(s, d):
    return weekday.sell_type_mix(T_(s, d), views.list_prices(s))


@query("Q18")
def sell_type_mix_singles(s, d):
    return weekday.sell_type_mix(T_(s, d), views.list_prices(s), singles_only=True)


# --- audience ------------------------------------------------------------------------------------------------


def _age_summary(s, d, name):
    seats = T_(s, d)
    now = [f"PS 00-01 {name}"]
    both = seats.where(F.col("season_desc").isin("PS 00-01 Classics", "PS 00-01 Pops"))
    return audience.age_group_summary(seats.where(F.col("season_desc").isin(now)), both, views.birth_years(s, d),
                                      D_(s, d), AS_OF)


@query("Q19 P10 P23 B10 A3 A8 J2 J6", digits=8)
def age_group_summary_classics(s, d):
    return _age_summary(s, d, "Classics")


@query("Q19", digits=8)
def age_group_summary_pops(s, d):
    return _age_summary(s, d, "Pops")


@query("Q20 B11 F10 W1 O4")
def age_by_dow(s, d):
    return weekday.ages_by_weekday(T_(s, d), views.birth_years(s, d), AS_OF_YEAR)


@query("Q21 J10 J11 J13 P14")
def customer_flow(s, d):
    return audience.customer_flow(T_(s, d), 400, excluded_ids=[2])


@query("Q22 B5 B17 J11")
def audience_mix(s, d):
    return audience.audience_mix(T_(s, d), THIS_FY, CUTOFF)


@query("Q22")
def audience_mix_counts(s, d):
    return audience.audience_mix_counts(audience.audience_mix(T_(s, d), THIS_FY, CUTOFF))


@query("J13 U2")
def single_buyers(s, d):
    return audience.single_buyers(T_(s, d), THIS_FY, CUTOFF)


@query("Q23 P9 A13", digits=8)
def customer_frequency_value(s, d):
    return audience.frequency_value(T_(s, d), RULES, POPS)


@query("Q23", digits=8)
def customer_frequency_value_classics(s, d):
    return audience.frequency_value(T_(s, d), RULES, CLASSICS)


@query("Q23", digits=8)
def customer_frequency_value_all(s, d):
    return audience.frequency_value(T_(s, d), RULES)


@query("Q24 B14 A11", digits=8)
def customer_segments(s, d):
    return audience.segments(T_(s, d), RULES)


@query("Q25 P12 A7")
def audience_key_sets(s, d):
    return audience.key_sets(T_(s, d), RULES)


@query("Q26 P11 B7 B15 J2 P18")
def concert_audience(s, d):
    return audience.concert_audience(T_(s, d), D_(s, d), RULES, POPS, [CONCERT])


@query("Q26")
def concert_audience_season(s, d):
    return audience.concert_audience(T_(s, d), D_(s, d), RULES)


@query("Q26")
def concert_audience_this_year_gifts(s, d):
    return audience.concert_audience(T_(s, d), D_(s, d), RULES, gifts_from=THIS_FY)


@query("Q27 U4")
def audience_counts(s, d):
    return audience.audience_counts(audience.concert_audience(T_(s, d), D_(s, d), RULES))


@query("Q28 B19 F2 J12 A13")
def seat_finder(s, d):
    seats = audience.one_day(T_(s, d, CONCERT, "2001-04-27"), CONCERT)
    here = keys.key_set(audience.counted_seats(seats, RULES), "summary_cust_id")
    return audience.seat_finder(seats, T_(s, d, customers=here), views.customers(s, d), RULES)


@query("A13 A15")
def seats_within_cap(s, d):
    return keys.counts_within(T_(s, d).where(F.col("summary_cust_id") > 0), "summary_cust_id", RULES.seat_cap, "seats")


@query("W3 J10 O1")
def performance_numbers(s, d):
    return audience.performance_numbers(T_(s, d))


@query("P12 A11")
def latest_year_seats(s, d):
    seats = T_(s, d).withColumn("fy", c.fiscal_year(F.col("perf_dt")))
    last = keys.latest(seats, "fy", None)
    return (seats.where(F.col("fy") >= last - 1).groupBy("fy", "price_type_group")
            .agg(F.count("*").alias("seats"), F.sum("paid_amt").alias("paid")))


@query("Q37")
def sub_flex_by_fy(s, d):
    return audience.subscriptions_by_year(T_(s, d), 1995, 2002)


@query("Q35")
def first_time_subscribers(s, d):
    return audience.first_time_subscribers(T_(s, d), THIS_FY)


@query("Q36 P5", digits=8)
def upgrade_prospects_classics(s, d):
    return audience.upgrade_prospects(T_(s, d), D_(s, d), RULES, "Classics")


@query("Q36", digits=8)
def upgrade_prospects_pops(s, d):
    return audience.upgrade_prospects(T_(s, d), D_(s, d), RULES, "Pops")


# --- concerts ------------------------------------------------------------------------------------------------


@query("Q29 A6 A12 B4 F3 P17", digits=8)
def performance_summary(s, d):
    return concert.performance_summary(T_(s, d))


def _one_summary(s, d):
    return concert.performance_summary(audience.one_day(T_(s, d, CONCERT, "2001-04-27"), CONCERT))


@query("Q29 P11", digits=8)
def performance_revenue_view(s, d):
    return concert.view(_one_summary(s, d), concert.GENERAL)


@query("Q29", digits=8)
def performance_comp_view(s, d):
    return concert.view(_one_summary(s, d), concert.COMPS)


@query("Q29", digits=8)
def performance_attendance_view(s, d):
    return concert.view(_one_summary(s, d), concert.ATTENDANCE)


@query("F14")
def performance_formatted(s, d):
    return concert.formatted(concert.performance_summary(T_(s, d)))


@query("Q30 F8 U5 U6 A9 P8")
def concert_revenue_monthly(s, d):
    return concert.revenue_monthly(T_(s, d), AS_OF)


@query("Q31")
def concert_revenue_annual(s, d):
    return concert.revenue_annual(concert.revenue_monthly(T_(s, d), AS_OF))


# --- donors --------------------------------------------------------------------------------------------------


@query("Q32 J3 P7")
def major_donor_friday_subs(s, d):
    return donors.major_donor_subscribers(D_(s, d), T_(s, d), views.customers(s, d), 2000, AS_OF)


@query("Q33 W4 B16 U1 F12")
def donor_retention(s, d):
    return donors.retention(D_(s, d))


@query("Q34 A6 B12 J4")
def legacy_donors(s, d):
    customers = audience.with_segment(audience.facts(T_(s, d), RULES))
    return donors.legacy_donors(D_(s, d), views.birth_years(s, d), customers, THIS_FY, AS_OF_YEAR)


@query("B6 B7 B8")
def giving_band_rules(s, d):
    return donors.bands_by_rule(D_(s, d))


@query("Q38 A10 W2 A14 P16 B18")
def revenue_mix_aggregate(s, d):
    return revenue.mix_aggregate(D_(s, d), T_(s, d), SEASONS)


@query("Q39 B5 B8 U3")
def revenue_mix_split(s, d):
    return revenue.mix_split(D_(s, d), T_(s, d), SEASONS)


# --- web -----------------------------------------------------------------------------------------------------


def _sessions(s, d, attribute=()):
    return web.sessionise(views.web_hits(s, d), HALF_DAY, attribute)


# The metrics of the channel report.
_CHANNEL_METRICS = ("sessions", "pageviews", "bounces", "avg_session_duration", "transactions",
                    "transaction_revenue", "total_value", "item_revenue")


@query("Q41 S9 B20", digits=4)
def channel_report_by_date(s, d):
    return web.report(_sessions(s, d, ("channel", "date")), _CHANNEL_METRICS, ["channel", "date"])


@query("Q41 S9 S11", digits=4)
def channel_report(s, d):
    recent = web.between_dates(_sessions(s, d, ("channel",)), (c.days_ago("2024-01-30", 20), c.days_ago("2024-01-30", 1)))
    return web.report(recent, _CHANNEL_METRICS, ["channel"])


@query("Q41 B20", digits=6)
def page_report(s, d):
    return web.report(_sessions(s, d), ("sessions", "bounces", "exits", "avg_time_on_page", "page_value"), ["page"])


@query("Q42")
def arrivals_by_age(s, d):
    return web.report(_sessions(s, d, ("channel",)), ["sessions"], ["channel", "age_bracket"])


@query("Q42")
def transactions_by_age(s, d):
    return web.report(views.web_hits(s, d), ["transactions", "transaction_revenue"], ["age_bracket"])


@query("Q43 O2 U3 U4")
def top_exit_pages(s, d):
    return web.exit_pages_by_bracket(_sessions(s, d))


@query("Q44 O2 O4")
def top_ad_groups(s, d):
    return web.top_ad_groups(views.web_hits(s, d))


@query("Q45 P13")
def peak_social_days(s, d):
    return web.peak_days(views.web_hits(s, d))


@query("Q46 A1")
def monthly_web_value(s, d):
    return web.monthly_value(views.web_hits(s, d))


@query("S10 S9 F11 B20", digits=4)
def daily_web_backfill(s, d):
    picked = web.between_dates(_sessions(s, d), ("2024-01-01", "2024-01-12"), ("2024-01-15", "2024-01-28"))
    daily = web.report(picked, _DAILY_METRICS, ["date"])
    return daily.withColumn("log_new_users", c.log_or_null(F.col("new_users")))


# The metrics of the daily value report.
_DAILY_METRICS = ("avg_session_duration", "unique_page_views", "impressions", "avg_time_on_page", "ad_cost",
                  "new_users", "percent_new_sessions", "total_value")


@query("B20")
def ad_costs_by_device(s, d):
    return web.report(_sessions(s, d), ("ad_clicks", "ad_cost", "new_users", "roas"), ["device", "date"])


# --- marketing -----------------------------------------------------------------------------------------------


@query("Q40 A5 P18")
def promotion_conversion(s, d):
    return marketing.promotion_conversion(views.promotions(s, d))


@query("Q47 P19 J13")
def monthly_single_revenue(s, d):
    return marketing.monthly_single_revenue(T_(s, d))


@query("Q48 A8")
def performances_per_month(s, d):
    return marketing.performances_per_month(T_(s, d))


@query("Q49 F6 P22 P3")
def monthly_expense_matrix(s, d):
    return marketing.expense_matrix(views.expenses(s, d))


def _mix(s, d):
    traffic = web.monthly_traffic(_sessions(s, d))
    return marketing.mix_table(T_(s, d), views.expenses(s, d), traffic)


@query("Q50 J6")
def marketing_mix_table(s, d):
    return _mix(s, d)


def _band(s, d):
    """Months near the mean: the test tables' revenue grows with their size. The rows are read twice, so they are stored."""
    mix = materialise(_mix(s, d))
    return marketing.in_band(mix, *(keys.scalar(mix, F.avg("revenue") * part) for part in (0.7, 1.1)))


@query("Q50 P15")
def marketing_mix_band(s, d):
    return _band(s, d)


@query("M5 F11")
def marketing_fit_lines(s, d):
    return marketing.fit_lines(_band(s, d))


@query("Q54")
def ab_conversion(s, d):
    return abtest.conversion(views.ab_outcomes(s, d))


@query("Q54")
def ab_separated(s, d):
    return abtest.separated(abtest.conversion(views.ab_outcomes(s, d)), "receive", "no_receive")


# --- baskets -------------------------------------------------------------------------------------------------


def _baskets(s, d):
    return basket.baskets(T_(s, d), views.performances(s, d))


@query("Q55 S7 J1")
def baskets(s, d):
    return _baskets(s, d).select("summary_cust_id", F.concat_ws("|", "items").alias("items"))


@query("M1")
def frequent_itemsets(s, d):
    return basket.frequent_itemsets(_baskets(s, d), support=0.1)


@query("M2")
def association_rules(s, d):
    return basket.association_rules(_baskets(s, d))


@query("M1")
def vertical_itemsets(s, d):
    found = itemsets.itemsets(_baskets(s, d), support=0.02, least_items=2, most_items=3)
    return found.withColumn("items", F.concat_ws("|", "items"))


@query("M2")
def rules_by_confidence(s, d):
    return itemsets.rules(_baskets(s, d), support=0.0, confidence=0.2, most_items=2)


# --- series --------------------------------------------------------------------------------------------------


@query("Q51 P20 J6 P10")
def revenue_per_performance(s, d):
    return revenue.per_performance(T_(s, d), AS_OF, SINGLE_CAP)


def _series(s, d):
    return revenue.monthly_series(revenue.per_performance(T_(s, d), AS_OF, SINGLE_CAP), SERIES_FIRST, SERIES_LAST)


@query("Q52 T1 S13")
def monthly_revenue_series(s, d):
    return _series(s, d)


@query("T2 W5")
def revenue_difference(s, d):
    return series.difference(_series(s, d))


@query("T3 W7")
def seasonal_naive(s, d):
    return series.seasonal_naive(_series(s, d))


@query("T3", digits=4)
def seasonal_naive_accuracy(s, d):
    return series.residual_deviation(series.seasonal_naive(series.difference(_series(s, d))))


@query("W6 T4")
def lag_pairs(s, d):
    return series.lagged_pairs(_series(s, d))


@query("T4 W6")
def lag_correlations(s, d):
    return series.lag_correlations(_series(s, d))


@query("T4", digits=4)
def residual_autocorrelation(s, d):
    return series.residual_autocorrelation(series.seasonal_naive(_series(s, d)))


@query("W8")
def seasonal_view(s, d):
    return series.seasonal_view(_series(s, d))


@query("T5")
def decomposition(s, d):
    return series.decompose(_series(s, d))


@query("T5")
def local_decomposition(s, d):
    return decomposition_.local_decomposition(_series(s, d))


@query("T5")
def robust_decomposition(s, d):
    return decomposition_.local_decomposition(_series(s, d), robust=True)


@query("T6", digits=4)
def simple_smoothing(s, d):
    return series.simple_smoothing(_series(s, d))


@query("T6", digits=4)
def exponential_smoothing(s, d):
    return series.exponential_smoothing(_series(s, d))


@query("T6", digits=4)
def smoothing_accuracy(s, d):
    return series.smoothing_accuracy(_series(s, d))


@query("T6", digits=4)
def smoothing_choice(s, d):
    return smoothing.choose_smoothing(_series(s, d))


@query("T6", digits=4)
def smoothing_forecast(s, d):
    return smoothing.smoothing_forecast(_series(s, d))


@query("T7", digits=4)
def seasonal_autoregression(s, d):
    return series.seasonal_autoregression(_series(s, d))


@query("T7", digits=4)
def autoregressive_forecast(s, d):
    return series.autoregressive_forecast(_series(s, d))


@query("T7", digits=4)
def auto_order_choice(s, d):
    return orders.choose_orders(_series(s, d))


@query("T7", digits=4)
def auto_order_forecast(s, d):
    return orders.auto_order_forecast(_series(s, d))


@query("M6 F15")
def revenue_trend_cubic(s, d):
    return series.polynomial_trend(_series(s, d), 3)


@query("M6 F15")
def weekday_trend_degree_8(s, d):
    return series.polynomial_trend(
        weekday.monthly_series(T_(s, d), "tix_sold", FIRST_MONTH, "2001-11-01"), 8)


# --- regressions ---------------------------------------------------------------------------------------------

# Columns that are no predictors, and predictors left out of the model.
_EXCLUDED = ("perf_dt", "fy", "goal", "word_plays", "lag_subs_1yr", "number_of_words", "connections")


def _revenue_model(s, d):
    features = views.performance_features(s, d)
    train = features.where(F.col("fy") < THIS_FY)
    return regression.fit_linear(train, regression.all_but(features, "revenue", _EXCLUDED)), train, features


@query("M3 P24", digits=4)
def performance_regression(s, d):
    model, train, _ = _revenue_model(s, d)
    return regression.coefficients(model, train).drop("p_value")


@query("M3", digits=4)
def aliased_regression(s, d):
    """A design without full rank: strings are violin and piano together, pairs twice the flexible seats."""
    train = views.performance_features(s, d).where(F.col("fy") < THIS_FY).select(
        "revenue", "flex_sold", "guest_violin", "guest_piano", (F.col("guest_violin") + F.col("guest_piano")).alias("strings"),
        "opera", (2 * F.col("flex_sold")).alias("pairs"))
    model = regression.fit_linear(train, regression.all_but(train, "revenue"))
    return regression.coefficient_table(model, train)


@query("M3", digits=4)
def performance_regression_quality(s, d):
    model, train, _ = _revenue_model(s, d)
    return regression.quality(model, train)


@query("Q53 M7 A17 J14 F13", digits=4)
def forecast_vs_goal(s, d):
    model, train, _ = _revenue_model(s, d)
    return regression.forecast_errors(regression.score(model, train))


@query("Q53 M7 J14", digits=4)
def projection_difference(s, d):
    model, _, features = _revenue_model(s, d)
    ahead = features.where(F.col("fy") == THIS_FY).withColumnRenamed("goal", "projected")
    return regression.projection_difference(regression.score(model, ahead)).select(
        "perf_dt", "projected", "prediction", "difference")


@query("A17 F13", digits=4)
def goal_errors(s, d):
    features = views.performance_features(s, d)
    return features.agg(regression.rmse(F.col("revenue"), F.col("goal")).alias("rmse_goal"),
                        regression.mape(F.col("revenue"), F.col("goal")).alias("mape_goal"))


@query("M3 P24", digits=4)
def roas_regression(s, d):
    daily = web.report(_sessions(s, d), ("roas", "new_users", "ad_cost"), ["device", "date"]).dropna()
    model = regression.fit_linear(daily, regression.all_but(daily, "roas", ["date"]))
    return regression.coefficients(model, daily).drop("p_value")


def _daily_value(s, d):
    daily = web.report(_sessions(s, d), _DAILY_METRICS, ["device", "date"]).dropna()
    # One is added before the logarithm: most test days have no new user, and R would stop at an infinite predictor.
    daily = daily.withColumn("new_users", F.ln(F.col("new_users") + 1))
    train = ranking.in_first_part(F.concat("device", F.col("date").cast("string")))
    return daily, train


@query("M8")
def web_days_split(s, d):
    daily, train = _daily_value(s, d)
    return daily.select("device", "date", train.alias("is_training"))


@query("M8")
def web_days_exact_split(s, d):
    """Exactly 80 % of the days of every device."""
    days, _ = _daily_value(s, d)
    return ranking.exact_split(days.select("device", "date"), F.concat("device", F.col("date").cast("string")), ["device"],
                               "is_training")


@query("M3 M7 M8 J5", digits=4)
def web_value_scored(s, d):
    daily, train = _daily_value(s, d)
    model = regression.fit_linear(daily.where(train), regression.all_but(
        daily, "total_value", ["date", "device", "percent_new_sessions"]))
    return regression.score(model, daily.where(~train)).select("device", "date", "total_value", "prediction")


@query("M4 F11")
def marketing_log_regression(s, d):
    logged = _band(s, d).withColumns({"log_sessions": c.log_or_null(F.col("sessions")),
                                     "log_digital_ads": c.log_or_null(F.col("digital_ads"))}).dropna()
    model = regression.fit_linear(logged, regression.formula("log_sessions", [
        "log_digital_ads", "print_total", "email_services", "direct_mail", "radio_and_tv", "performances",
        "promotions"]))
    return regression.coefficients(model, logged).select("term", "estimate")


@query("M4 F11", digits=6)
def marketing_revenue_regression(s, d):
    spent = (marketing.spend_and_revenue(T_(s, d), views.expenses(s, d))
             .withColumn("log_revenue", c.log_or_null(F.col("revenue"))).dropna(subset=["log_revenue"]))
    model = regression.fit_linear(spent, regression.formula("log_revenue", [
        "digital_ads", "print_media", "print_production", "email_services", "direct_mail", "radio_and_tv", "performances",
        "promotions"]))
    return regression.coefficients(model, spent).drop("p_value")


_VIEWER_PREDICTORS = ("view", "totvids", "elecvids", "browser", "device", "age", "gender")


@query("M9 S8")
def viewer_probabilities(s, d):
    train = views.viewers(s, d)
    model = regression.fit_logistic(train, "buy ~ view")
    return (regression.score(model, train).groupBy("view")
            .agg(F.count("*").alias("viewers"), F.avg("prediction").alias("probability")))


@query("M9 M10", digits=4)
def viewer_deviance(s, d):
    train = views.viewers(s, d)
    return regression.deviance(regression.score(regression.fit_logistic(train, "buy ~ view"), train), "buy")


@query("M9 M10", digits=4)
def viewer_holdout_deviance(s, d):
    train, held = views.viewers(s, d), views.viewers(s, d, holdout=True)
    model = regression.fit_logistic(train, regression.formula("buy", _VIEWER_PREDICTORS))
    return regression.deviance(regression.score(model, held), "buy")


@query("M11", digits=4)
def viewer_likelihood_ratio(s, d):
    train = views.viewers(s, d)
    small = regression.fit_logistic(train, "buy ~ view")
    large = regression.fit_logistic(train, regression.formula("buy", _VIEWER_PREDICTORS))
    return regression.likelihood_ratio(small, large, train)


@query("W9 O5 M7")
def viewer_tail_rates(s, d):
    """Rates of the held-out viewers by a one-predictor score: long ties, broken by viewer."""
    train, held = views.viewers(s, d), views.viewers(s, d, holdout=True)
    rates = train.groupBy("view").agg(F.avg("buy").alias("score"))
    scored = held.join(rates, "view")
    return regression.tail_rates(ranking.global_ntile(
        scored.select("viewer_id", "buy", "score"), 5, "score", "viewer_id", "tile"))


@query("W9 O5")
def viewer_model_tail_rates(s, d):
    train, held = views.viewers(s, d), views.viewers(s, d, holdout=True)
    model = regression.fit_logistic(train, regression.formula("buy", _VIEWER_PREDICTORS))
    scored = regression.score(model, held).select("viewer_id", "buy", "prediction")
    return regression.tail_rates(ranking.global_ntile(scored, 5, "prediction", "viewer_id", "tile"))


# --- columns and single operators ----------------------------------------------------------------------------


@query("P1 P2 P3 P4 P6 F1 F2 F3 F4 F7 B1 B2 B3 B4 B5 B9 B19")
def ticket_columns(s, d):
    raw = F.col("price_type_group")
    fy = c.fiscal_year(F.col("perf_dt"))
    return T_(s, d).select(
        "summary_cust_id", "perf_dt", "paid_amt", fy.alias("fy"),
        c.fiscal_year(F.col("perf_dt"), 1997, 2000).alias("fy_clamped"),
        c.season_label(fy).alias("season"), c.short_fiscal_label(fy).alias("fy_label"),
        c.weekday(F.col("perf_dt")).alias("day_of_week"), c.price_zone(F.col("zone_desc")).alias("price_zone"),
        c.price_type(raw).alias("price_type"), c.report_price_type(raw).alias("report_type"),
        c.subscription_or_single(raw).alias("sub_or_single"), c.single_or_subscription(raw).alias("single_or_sub"),
        c.attended_flag(F.col("attended")).alias("attended"),
        c.seat_label(F.col("section"), F.col("row"), F.col("seat")).alias("seat_label"))


@query("B10 B11 B12")
def customer_age_columns(s, d):
    born = F.col("key_value")
    return views.birth_years(s, d).select(
        "customer_no", "key_value", F.coalesce(c.age(born, AS_OF_YEAR), F.lit(-1)).alias("age"),
        c.age_group(born).alias("age_group"), c.age_decade(c.age(born, AS_OF_YEAR)).alias("age_decade"))


@query("S4 F5 F6 F9 F10 P22")
def parsed_dates(s, d):
    """Order times written in both text forms of the extracts, then parsed back."""
    orders = views.table(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    full = F.date_format("at", "M/d/yyyy h:mm:ss a")
    short = F.date_format("at", "M/d/yyyy H:mm")
    text = F.when(F.col("o_orderkey") % 3 == 0, short).otherwise(full)
    parsed = orders.select("o_orderkey", c.parse_timestamp(text, ("M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm")).alias("t"))
    return parsed.select("o_orderkey", F.col("t").alias("order_time"), c.month_start(F.col("t")).alias("order_month"),
                         F.year("t").alias("order_year"), F.date_add(F.col("t").cast("date"), 1).alias("next_day"))


@query("P21 O3")
def order_sample(s, d):
    return ranking.repeatable_sample(views.table(s, d, "orders"), 10, "o_orderkey").select("o_orderkey", "o_custkey")


@query("A16", digits=4)
def gift_summary(s, d):
    gifts = D_(s, d).withColumn("spread", F.xxhash64("summary_cust_id", "gift_plus_pledge", "cont_fy"))
    return ranking.five_numbers(gifts, ["gift_plus_pledge", "cont_fy", "summary_cust_id"], "spread")


@query("A18")
def price_density(s, d):
    paid = T_(s, d).where(F.col("paid_amt") > 0)
    return ranking.binned_density(paid, ["price_type_group"], "paid_amt", 0, 120, 24)


@query("A18", digits=8)
def price_kernel_density(s, d):
    paid = T_(s, d).where(F.col("paid_amt") > 0)
    return density.kernel_density(paid, ["price_type_group"], "paid_amt")


@query("W1 A2 A6")
def zone_shares_by_fy(s, d):
    sold = T_(s, d).where(F.col("paid_amt") > 0).groupBy(
        c.fiscal_year(F.col("perf_dt")).alias("fy"), c.price_zone(F.col("zone_desc")).alias("price_zone")).agg(
        F.sum("paid_amt").alias("paid"), F.count_if(F.col("attended") == "Attended").alias("attended"))
    return reshape.share_of_total(sold, "paid", ["fy"], "share")


# --- files ---------------------------------------------------------------------------------------------------


@query("S5")
def season_store(s, d):
    """Store tickets by season, load named seasons back."""
    path = scratch_folder(s, "seasons")
    extracts.store_by_season(T_(s, d), path)
    return (extracts.load_tickets(s, path, [*POPS, *CLASSICS]).groupBy("season_desc", "price_type_group")
            .agg(F.count("*").alias("seats"), F.sum("paid_amt").alias("paid")))


@query("S1 S4 F5")
def extract_scan(s, d):
    """Write gifts and order times as extracts with preamble lines, scan them back."""
    path = scratch_folder(s, "extract")
    orders = views.table(s, d, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(at, "M/d/yyyy H:mm")).otherwise(
        F.date_format(at, "M/d/yyyy h:mm:ss a"))
    extracts.write_extract(orders.select("o_orderkey", "o_totalprice", text.alias("order_dt")), path,
                           ["Orders", "all seasons", ""])
    rows = extracts.read_extract(s, path, "o_orderkey BIGINT, o_totalprice DOUBLE, order_dt STRING", preamble=3)
    return rows.select("o_orderkey", "o_totalprice",
                       c.parse_timestamp(F.col("order_dt"), schemas.TIMESTAMP_FORMS).alias("order_time"))


@query("S14 U1")
def report_sheets(s, d):
    """Save two report sheets, append to one, and read them back."""
    path = scratch_folder(s, "report")
    by_type = T_(s, d).groupBy("price_type_group").agg(F.count("*").alias("seats"))
    extracts.save_report({"types": by_type, "revenue": weekday.revenue(T_(s, d))}, path)
    extracts.save_report({"types": by_type}, path, append=True)
    types = extracts.load_sheet(s, path, "types").select(F.lit("types").alias("sheet"),
                                                         F.col("price_type_group").alias("item"),
                                                         F.col("seats").cast("double").alias("value"))
    return types.unionByName(extracts.load_sheet(s, path, "revenue").select(
        F.lit("revenue").alias("sheet"), F.col("day_of_week").alias("item"), F.col("rev").alias("value")))


@query("S2")
def birth_year_extract(s, d):
    """An extract with seven preamble lines."""
    path = scratch_folder(s, "births")
    extracts.write_extract(views.birth_years(s, d), path, ["note"] * 7)
    return extracts.read_birth_years(s, path, preamble=7)


@query("S3 S6")
def donation_csv(s, d):
    """Donations as plain CSV, through the donation loader."""
    path = scratch_folder(s, "donations")
    D_(s, d).write.csv(path, header=True)
    return (extracts.load_donations(s, path).groupBy("cont_fy")
            .agg(F.count("*").alias("gifts"), F.sum("gift_plus_pledge").alias("given")))


@query("S14")
def grouped_report_sheets(s, d):
    """One sheet per weekday, read back together."""
    path = scratch_folder(s, "sheets")
    extracts.save_grouped_report(weekday.revenue(T_(s, d)), path, "day_of_week")
    return s.read.parquet(path).select(F.col("day_of_week").cast("string"), "rev")


@query("S7")
def performance_names(s, d):
    """Performance names as a file, through their loader."""
    path = scratch_folder(s, "names")
    views.performances(s, d).withColumn("perf_dt", F.date_format("perf_dt", "yyyy-MM-dd HH:mm:ss")).write.csv(path, header=True)
    return extracts.read_performances(s, path)
