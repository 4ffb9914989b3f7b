"""Per-performance summaries and concert revenue trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from houselights.functions import columns as c
from houselights.operators import reshape

GENERAL = ("seats", "sub_sold", "sub_avg", "sub_rev", "sgl_sold", "sgl_avg", "sgl_rev", "tot_sold", "prcnt_sold",
           "tot_rev")
COMPS = ("seats", "tot_comp", "prcnt_comp")
ATTENDANCE = ("seats", "att", "comp_att", "sub_att", "sgl_att", "tot_att")
_DAYS = {"Thursday": "thursday", "Friday": "friday", "Saturday": "saturday"}


def performance_summary(tickets: DataFrame) -> DataFrame:
    """Sales, comps and attendance per performance and price zone, with a total row per performance.

    Ratios are taken after the totals, so a zone without comps leaves no hole in the total row.
    """
    seats = tickets.select(
        "perf_dt", c.price_zone(F.col("zone_desc")).alias("zone"), "paid_amt",
        c.report_price_type(F.col("price_type_group")).alias("kind"),
        (F.col("attended") == "Attended").alias("here"))
    sub, sgl, comp = (F.col("kind") == kind for kind in ("Subscription", "Single", "Comp"))

    def paid(of):
        return F.coalesce(F.sum(F.when(of, F.col("paid_amt"))), F.lit(0.0))

    counts = {
        "seats": F.count("*"), "sub_sold": F.count_if(sub), "sub_rev": paid(sub), "sgl_sold": F.count_if(sgl),
        "sgl_rev": paid(sgl), "tot_comp": F.count_if(comp), "att": F.count_if("here"),
        "comp_here": F.count_if(F.col("here") & comp), "sub_here": F.count_if(F.col("here") & sub),
        "sgl_here": F.count_if(F.col("here") & sgl),
    }
    zones = seats.groupBy("perf_dt", "zone").agg(*[measure.alias(name) for name, measure in counts.items()])
    grouped = reshape.with_total_rows(zones, ["perf_dt"], "zone", list(counts))
    # Sums of cents are rounded to the cent, so averages do not depend on the order of adding.
    grouped = grouped.withColumns({name: F.round(name, 2) for name in ("sub_rev", "sgl_rev")})
    sold = F.col("sub_sold") + F.col("sgl_sold")
    return grouped.select(
        "perf_dt", "zone", "seats", "sub_sold", c.ratio(F.col("sub_rev"), F.col("sub_sold")).alias("sub_avg"),
        "sub_rev", "sgl_sold", c.ratio(F.col("sgl_rev"), F.col("sgl_sold")).alias("sgl_avg"), "sgl_rev",
        sold.alias("tot_sold"), c.ratio(sold, F.col("seats")).alias("prcnt_sold"),
        (F.col("sub_rev") + F.col("sgl_rev")).alias("tot_rev"), "tot_comp",
        c.ratio(F.col("tot_comp"), F.col("seats")).alias("prcnt_comp"), "att",
        c.ratio(F.col("comp_here"), F.col("tot_comp")).alias("comp_att"),
        c.ratio(F.col("sub_here"), F.col("sub_sold")).alias("sub_att"),
        c.ratio(F.col("sgl_here"), F.col("sgl_sold")).alias("sgl_att"),
        c.ratio(F.col("att"), sold + F.col("tot_comp")).alias("tot_att"))


def view(summary: DataFrame, columns: Sequence[str]) -> DataFrame:
    return summary.select("perf_dt", "zone", *columns)


def formatted(summary: DataFrame) -> DataFrame:
    """Money and rates as text, for presentation only."""
    money = ("sub_avg", "sub_rev", "sgl_avg", "sgl_rev", "tot_rev")
    rates = ("prcnt_sold", "prcnt_comp", "comp_att", "sub_att", "sgl_att", "tot_att")
    texts = {name: c.dollars(F.col(name)) for name in money}
    texts.update({name: c.percent(F.col(name)) for name in rates})
    return summary.withColumns(texts)


def revenue_monthly(tickets: DataFrame, last_date: str, zone: str = "America/Los_Angeles") -> DataFrame:
    """Mean revenue per performance by month for each regular weekday; months that have all three.

    The weekday is the local one of the hall.
    """
    per_performance = (tickets.where(F.col("summary_cust_id").isNotNull() & F.col("paid_amt").isNotNull()
                                     & (F.col("perf_dt") < F.date_add(F.lit(last_date).cast("date"), 1)
                                        .cast("timestamp_ntz")))
                       .groupBy("perf_dt").agg(F.sum("paid_amt").alias("paid")))
    local = per_performance.select("paid", F.date_format("perf_dt", "yyyy-MM").alias("date"),
                                   c.weekday(F.col("perf_dt").cast("timestamp"), zone).alias("day"))
    wide = reshape.pivot_fixed(local.where(F.col("day") != "Tuesday"), ["date"], "day", _DAYS, F.avg("paid"))
    return wide.dropna(subset=list(_DAYS.values()))


def revenue_annual(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy(F.substring("date", 1, 4).alias("year")).agg(
        *[F.avg(name).alias(name) for name in _DAYS.values()])
