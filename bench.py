"""Time registered queries once each, after a warm-up, and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated names).
"""

from __future__ import annotations

import json
import os
import sys
import time

from houselights import catalog
from houselights.session import build_session

HEADLINE = (
    "dow_revenue dow_subscribers dow_donors zone_percent_sold zone_major_donors monthly_dow_revenue subscriber_tenure "
    "sell_type_mix age_group_summary_classics age_by_dow customer_flow audience_mix customer_segments "
    "audience_key_sets concert_audience_season audience_counts seat_finder performance_summary "
    "concert_revenue_monthly major_donor_friday_subs donor_retention legacy_donors upgrade_prospects_classics "
    "revenue_mix_split channel_report_by_date page_report top_exit_pages top_ad_groups monthly_single_revenue "
    "monthly_expense_matrix marketing_mix_table baskets frequent_itemsets monthly_revenue_series seasonal_naive "
    "residual_autocorrelation decomposition exponential_smoothing autoregressive_forecast performance_regression "
    "viewer_likelihood_ratio viewer_model_tail_rates gift_summary").split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", cpus, **{
        "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.sql.files.maxPartitionBytes": "8m"})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["dow_revenue"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
