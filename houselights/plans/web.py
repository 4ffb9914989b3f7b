"""Web reports: any named metrics by any named dimensions, computed from the event stream.

Sessions are cut in two levels so that one very busy user does not end up in one task: hits are grouped by user and
minute, and only the first and last moment of each minute travel to the per-user step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from houselights.functions import columns as c
from houselights.operators import keys, ranking, reshape
from houselights.sources.views import AGE_BRACKETS

HALF_HOUR = 30 * 60


def between_dates(hits: DataFrame, *ranges: tuple[str | Column, str | Column], column: str = "date") -> DataFrame:
    """Hits in any of the date ranges, ends included: a backfill is one scan with one predicate."""
    condition = F.lit(False)
    for first, last in ranges:
        low, high = (F.lit(end).cast("date") if isinstance(end, str) else end for end in (first, last))
        condition = condition | F.col(column).between(low, high)
    return hits.where(condition)


def sessionise(hits: DataFrame, gap_seconds: int = HALF_HOUR, attribute: Sequence[str] = (),
               slice_seconds: int = 60) -> DataFrame:
    """Add to every hit: session start, whether it opens or closes the session, whether it is the user's first, and
    the time of the next hit of the session.

    A hit opens a session when at least `gap_seconds` passed since the user's previous hit. Time slices are no longer
    than the gap, so a session can only open at a slice's first hit. `attribute` names dimensions that belong to the
    session: every hit takes the opening hit's value. Hits without a user belong to no session and are left out.
    """
    gap = gap_seconds * 1_000_000
    width = min(gap_seconds, slice_seconds) * 1_000_000
    hits = (hits.where(F.col("user_id").isNotNull())
            .withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
            .withColumn("_slice", F.expr(f"at div {width}")))

    edges = hits.groupBy("user_id", "_slice").agg(
        F.min(F.struct("at", "event_id", *attribute)).alias("_first"), F.max("at").alias("_last"))
    by_user = Window.partitionBy("user_id").orderBy("_slice")
    edges = edges.withColumns({"_before": F.lag("_last").over(by_user), "_after": F.lead("_first.at").over(by_user)})
    opens = F.col("_before").isNull() | (F.col("_first.at") - F.col("_before") >= gap)
    so_far = by_user.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = edges.select("user_id", "_slice", "_before", "_after",
                         F.last(F.when(opens, F.col("_first")), ignorenulls=True).over(so_far).alias("_opener"))

    in_slice = Window.partitionBy("user_id", "_slice").orderBy("at", "event_id")
    joined = hits.drop(*attribute).join(edges, ["user_id", "_slice"])
    joined = joined.withColumns({"_prev": F.coalesce(F.lag("at").over(in_slice), "_before"),
                                 "_next": F.coalesce(F.lead("at").over(in_slice), "_after")})
    closes = F.col("_next").isNull() | (F.col("_next") - F.col("at") >= gap)
    return joined.withColumns({
        "session_start": F.col("_opener.at"),
        "opens": F.col("_prev").isNull() | (F.col("at") - F.col("_prev") >= gap),
        "is_new": F.col("_prev").isNull(),
        "closes": closes,
        "next_at": F.when(~closes, F.col("_next")),
        **{name: F.col("_opener")[name] for name in attribute},
    }).drop("_slice", "_before", "_after", "_opener", "_prev", "_next")


def _when(condition: Column, value: str | Column = "value") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value) if isinstance(value, str) else value)), F.lit(0.0))


def hit_metrics() -> dict[str, Column]:
    """Metric registry: aggregates over session-annotated hits, usable with any dimensions of a hit.

    Durations are sums of the gaps between consecutive hits, credited to the earlier hit, so they add up over any
    grouping. `unique_page_views` counts a page once per session.
    """
    kind, ad = F.col("event_type"), F.col("ad_group").isNotNull()
    purchase, click, page_view = kind == "purchase", kind == "click", kind == "view"
    stay = (F.col("next_at") - F.col("at")) / 1_000_000
    sessions = F.count_if("opens")
    impressions, clicks = F.count_if(page_view & ad), F.count_if(click & ad)
    cost = _when(click & ad, F.col("value") * 0.01)
    revenue = _when(purchase)
    total = _when(kind.isin("purchase", "signup"))
    views_once = F.countDistinct(F.when(page_view, F.struct("user_id", "session_start", "page")))
    return {
        "sessions": sessions,
        "pageviews": F.count_if(page_view),
        "bounces": F.count_if(F.col("opens") & F.col("closes")),
        "exits": F.count_if("closes"),
        "avg_session_duration": c.ratio(F.coalesce(F.sum(stay), F.lit(0.0)), sessions),
        # Rounded to the microsecond, so the mean does not depend on the order of adding.
        "avg_time_on_page": c.ratio(F.round(F.sum(stay), 6), F.count(stay)),
        "unique_page_views": views_once,
        "page_value": c.ratio(total, views_once),
        "transactions": F.count_if(purchase),
        "transaction_revenue": revenue,
        "item_revenue": revenue,
        "total_value": total,
        "new_users": F.count_if("is_new"),
        "percent_new_sessions": c.ratio(F.count_if("is_new"), sessions),
        "impressions": impressions,
        "ad_clicks": clicks,
        "ad_cost": cost,
        "cpm": c.ratio(cost * 1000, impressions),
        "cpc": c.ratio(cost, clicks),
        "rpc": c.ratio(revenue, clicks),
        "roas": c.ratio(revenue * 100, cost),
        "social_interactions": F.count_if(kind == "signup"),
    }


def report(session_hits: DataFrame, metrics: Sequence[str], dimensions: Sequence[str] = ()) -> DataFrame:
    """Named metrics by named dimensions."""
    registry = hit_metrics()
    return session_hits.groupBy(*dimensions).agg(*[registry[name].alias(name) for name in metrics])


def exit_pages_by_bracket(session_hits: DataFrame, k: int = 10) -> DataFrame:
    """Sessions ending on the k most frequent exit pages, by age bracket."""
    counted = (session_hits.where("closes").groupBy("page", "age_bracket").agg(F.count("*").alias("n")))
    names = {bracket: f"b{i}" for i, bracket in enumerate(AGE_BRACKETS)}
    wide = reshape.pivot_fixed(counted, ["page"], "age_bracket", names, F.sum("n"), fill=0)
    total = sum((F.col(name) for name in names.values()), F.lit(0))
    top = ranking.top_k(wide.withColumn("total", total), k, "total", ["page"]).drop("total")
    long = reshape.unpivot(top, ["page"], list(names.values()), "bracket", "sessions")
    label = F.col("bracket")
    for bracket, name in names.items():
        label = F.when(F.col("bracket") == name, bracket).otherwise(label)
    return (long.select("page", label.alias("age_bracket"), "sessions")
            .orderBy("age_bracket", F.col("sessions").desc(), "page"))


def top_ad_groups(hits: DataFrame, k: int = 20) -> DataFrame:
    """Ad groups with the best return on spend. Needs no sessions, so none are cut."""
    metrics = ("impressions", "cpm", "ad_clicks", "cpc", "total_value", "rpc", "roas")
    groups = report(hits.where(F.col("ad_group").isNotNull()), metrics, ["ad_group"])
    return ranking.top_k(groups.where(F.col("roas").isNotNull()), k, "roas", ["ad_group"])


def peak_days(hits: DataFrame, metric: str = "social_interactions") -> DataFrame:
    """Days on which a metric was highest, ties included."""
    return keys.keep_at_max(report(hits, [metric], ["date"]), metric)


def monthly_value(hits: DataFrame, column: str = "report_date") -> DataFrame:
    month = c.month_start(F.col(column)).alias("month")
    return hits.groupBy(month).agg(*[hit_metrics()[name].alias(name) for name in ("total_value", "impressions")])


def monthly_traffic(session_hits: DataFrame, column: str = "report_date") -> DataFrame:
    """Sessions, transactions and revenue per month, for the marketing tables."""
    month = c.month_start(F.col(column)).alias("date")
    return session_hits.groupBy(month).agg(
        *[hit_metrics()[name].alias(name) for name in ("sessions", "transactions", "transaction_revenue")])
