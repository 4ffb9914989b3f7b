from houselights.plans import audience, concert, donors, marketing, revenue, weekday
from houselights.sources import views

THU, FRI, SAT, TUE = ("2019-01-31 20:00:00", "2019-02-01 20:00:00", "2019-02-02 20:00:00", "2019-01-29 20:00:00")


def rows(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]


def donations(table, data):
    return table([(cid, float(g), fy, f"PS {(fy - 1) % 100:02d}-{fy % 100:02d} Annual", "Fund") for cid, g, fy in data],
                 "summary_cust_id bigint, gift_plus_pledge double, cont_fy int, campaign string, fund_desc string")


def test_percent_of_potential_revenue_worked_example(spark, tickets):
    """100 zone-1 seats on a Thursday at $121 could earn $12,100; 80 sold at $75 earned $6,000: 49.6 %."""
    seats = tickets([(i, "Single ", 75, THU) for i in range(1, 81)] + [(None, "Hold", 0, THU)] * 20)
    (got,) = rows(weekday.percent_of_potential_revenue(seats, views.list_prices(spark)))
    assert round(100 * got["percentage"], 1) == 49.6


def test_weekday_reports_skip_tuesday_and_unknown_types(tickets):
    seats = tickets([(1, "Flex", 10, THU, None, None, "Attended"), (1, "Flex", 20, TUE), (2, "Comp", 0, THU),
                     (3, None, 99, THU), (0, "Hold", 0, THU), (4, "Discount", 30, FRI)])
    assert rows(weekday.revenue(seats), "day_of_week") == [{"day_of_week": "Friday", "rev": 30.0},
                                                           {"day_of_week": "Thursday", "rev": 10.0}]
    assert rows(weekday.comps(seats)) == [{"day_of_week": "Thursday", "count": 1}]
    assert rows(weekday.unsold_seats(seats)) == [{"day_of_week": "Thursday", "count": 1}]
    assert rows(weekday.zone_percent_sold(seats)) == [
        {"day_of_week": "Thursday", "price_zone": "Price 1", "percentage_sold": 0.5}]
    assert [r.day_of_week for r in weekday.day_order(weekday.revenue(seats)).collect()] == ["Thursday", "Friday"]


def test_donors_without_gifts_are_band_h(tickets, table):
    seats = tickets([(1, "Flex", 10, THU), (1, "Flex", 10, THU), (2, "Flex", 10, THU)])
    got = rows(weekday.donors(seats, donations(table, [(1, 999, 2018), (1, 1, 2019)])), "donor_group")
    assert [(r["donor_group"], r["donors"]) for r in got] == [("F", 1), ("H", 1)]


def test_tenure_counts_years_of_current_holders(tickets):
    def perf(fy):
        return f"{fy}-01-03 20:00:00"
    seats = tickets([(1, "Subscription", 9, perf(y)) for y in (2015, 2016, 2017, 2018, 2019)]
                    + [(2, "Subscription", 9, perf(2018)), (3, "Flex", 9, perf(2019)), (4, "Subscription", 9, "2019-01-05 20:00:00")])
    got = {(r["day_of_week"], r["length_of_tenure"]): r["subscribers"] for r in rows(weekday.subscriber_tenure(seats, 2019))}
    assert got[("Saturday", "1")] == 1
    assert sum(got.values()) == 2


def test_one_day_is_strict_at_both_midnights(tickets):
    times = ["2019-01-31 00:00:00", "2019-01-31 00:00:01", "2019-01-31 23:59:59", "2019-02-01 00:00:00"]
    assert audience.one_day(tickets([(1, "Flex", 9, t) for t in times]), "2019-01-31").count() == 2


def test_summary_totals_are_ratios_of_totals(tickets):
    seats = tickets([(1, "Flex", 30, THU, "Price 1 - A", None, "Attended"), (2, "Subscription", 50, THU, "Price 1 - A"),
                     (3, "Discount", 20, THU, "Price 2 - B", None, "Attended"), (4, "Comp", 0, THU, "Price 2 - B"),
                     (None, "Hold", 0, THU, "Price 2 - B")])
    summary = concert.performance_summary(seats)
    one, two, total = rows(summary, "zone")
    assert (one["sub_sold"], one["sub_avg"], one["sgl_avg"], one["comp_att"]) == (2, 40.0, None, None)
    assert (two["seats"], two["prcnt_sold"], two["sgl_att"]) == (3, 1 / 3, 1.0)
    assert (total["zone"], total["seats"], total["tot_rev"], total["comp_att"], total["prcnt_sold"]) == (
        "Total", 5, 100.0, 0.0, 0.6)
    assert total["tot_att"] == 2 / 4
    text = rows(concert.formatted(summary), "zone")[2]
    assert (text["tot_rev"], text["prcnt_sold"]) == ("$100.00", "60.0%")
    assert concert.view(summary, concert.COMPS).columns == ["perf_dt", "zone", "seats", "tot_comp", "prcnt_comp"]


def test_concert_revenue_needs_all_three_days(tickets):
    seats = tickets([(1, "Flex", 10, THU), (1, "Flex", 30, "2019-01-24 20:00:00"), (1, "Flex", 5, "2019-01-25 20:00:00"),
                     (1, "Flex", 7, "2019-01-26 20:00:00"), (1, "Flex", 7, FRI), (None, "Flex", 100, THU), (1, "Flex", 9, TUE)])
    monthly = concert.revenue_monthly(seats, "2019-02-28")
    assert rows(monthly) == [{"date": "2019-01", "thursday": 20.0, "friday": 5.0, "saturday": 7.0}]
    assert rows(concert.revenue_annual(monthly))[0]["year"] == "2019"


def test_retention_follows_recorded_years_and_gaps(table):
    gifts = [(1, 500, 2014), (1, 2000, 2016),                    # up in the next recorded year (2015 has nobody)
             (2, 5000, 2014), (2, 50, 2016), (2, 50, 2017),      # down, then kept
             (3, 500, 2014), (3, 500, 2017),                     # lost in 2016, then back
             (4, 200000, 2016)]                                  # lost
    got = {(r["grp"], r["fy"]): r for r in rows(donors.retention(donations(table, gifts)))}
    assert set(got) == {("A", 2016), ("B", 2016), ("A", 2017), ("B", 2017), ("D", 2017)}
    a = got[("A", 2016)]
    assert (a["lost"], a["upgrade"], a["total_retention"]) == (0.5, 0.5, 0.5)
    assert got[("B", 2016)]["downgrade"] == 1.0 and got[("A", 2017)]["maintain"] == 1.0 and got[("D", 2017)]["lost"] == 1.0
    assert all(abs(r["lost"] + r["total_retention"] - 1) < 1e-12 for r in got.values())


def test_facts_apply_cap_before_payment_filter(tickets):
    rules = audience.AudienceRules(this_fy=2019, seat_cap=3)
    seats = tickets([(1, "Flex", 20, THU)] * 2 + [(1, "Comp", 0, THU)]
                    + [(2, "Flex", 20, THU)] * 2 + [(2, "Comp", 0, THU)] * 2
                    + [(3, "Flex", 5, THU), (0, "Flex", 50, THU), (None, "Flex", 50, THU)])
    got = rows(audience.frequency_value(seats, rules))
    assert [(r["summary_cust_id"], r["freq"], r["avg_paid_amt"]) for r in got] == [(1, 2, 20.0)]


def test_concert_audience_classes(tickets, table):
    rules = audience.AudienceRules(this_fy=2019)
    seats = tickets([(1, "Flex", 20, THU), (2, "Single ", 20, THU), (2, "Single ", 20, "2018-01-10 20:00:00"),
                     (3, "Single ", 20, THU), (3, "Single ", 20, "2016-10-10 20:00:00"), (4, "Single ", 20, THU),
                     (4, "Single ", 20, "2018-10-10 20:00:00"), (5, "Single ", 20, FRI)])
    got = audience.concert_audience(seats, donations(table, [(1, 1000, 2018), (9, 9, 2018)]), rules, dates=["2019-01-31"])
    by_id = {r["summary_cust_id"]: r for r in rows(got)}
    assert {k: r["classification"] for k, r in by_id.items()} == {1: "new", 2: "renew", 3: "return", 4: "renew"}
    assert by_id[1]["subscriber"] == 1 and by_id[1]["donor_group"] == "Group B" and by_id[2]["donor_group"] == "Group A"
    none = audience.concert_audience(seats, donations(table, [(1, 1, 2018)]), rules, seasons=["PS 18-19 Pops"])
    assert {r["segment"] for r in rows(none)} == {"0"}
    counts = {(r["dimension"], r["level"]): r["count"] for r in rows(audience.audience_counts(got))}
    assert counts[("classification", "renew")] == 2 and counts[("type", "single")] == 3


def test_customer_flow_counts_distinct_performances(tickets):
    seats = tickets([(1, "Single ", 9, TUE), (1, "Single ", 9, TUE), (1, "Single ", 9, THU), (1, "Single ", 9, SAT),
                     (2, "Single ", 9, TUE), (2, "Flex", 9, SAT), (3, "Comp", 0, TUE), (4, "Single ", 9, FRI),
                     (7, "Single ", 9, TUE)])
    got = rows(audience.customer_flow(seats, 2, excluded_ids=[7]))
    assert got == [{"total_perfs": 2, "total_customers": 1}]


def test_audience_mix_tenure(tickets):
    def sub(cust, *years):
        return [(cust, "Subscription", 9, f"{y}-01-10 20:00:00") for y in years]
    seats = tickets(sub(1, 2019) + sub(2, 2018, 2019) + sub(3, 2017, 2018, 2019) + sub(4, 2017, 2019)
                    + [(5, "Single ", 9, "2019-01-10 20:00:00"), (6, "Single ", 9, "2019-01-10 20:00:00"),
                       (6, "Comp", 0, "2016-01-10 20:00:00"), (8, "Single ", 9, "2019-03-01 20:00:00")])
    got = {r["summary_cust_id"]: (r["buyer"], r["class"]) for r in rows(audience.audience_mix(seats, 2019, "2019-01-31"))}
    assert got == {1: ("subscriber", "new"), 2: ("subscriber", "second_year"), 3: ("subscriber", "multi"),
                   4: ("subscriber", "multi"), 5: ("single", "new"), 6: ("single", "known")}
    assert sorted(r["summary_cust_id"] for r in rows(audience.single_buyers(seats, 2019, "2019-01-31"))) == [5, 6]


def test_age_summary_leaves_out_singles_of_subscribers(tickets, table):
    classics = tickets([(1, "Single ", 10, THU), (1, "Subscription", 20, THU, None, None, "Attended"),
                        (2, "Single ", 30, THU), (2, "Single ", 50, THU), (3, "Flex", 40, THU), (2, "Single ", 9, SAT)])
    births = table([(1, 1950), (2, 1950), (3, 0)], "customer_no bigint, key_value int")
    got = rows(audience.age_group_summary(classics, classics, births, donations(table, [(2, 500, 2018)]), "2019-02-01"),
               "price_type_group")
    assert [(r["price_type_group"], r["unique_customers"], r["tix_transactions"], r["paid_amt"]) for r in got] == [
        ("Single ", 1, 2, 80.0), ("Subscription", 1, 1, 20.0)]
    assert got[0]["average_annual_donation"] == 100.0 and got[1]["attendance_rate"] == 1.0


def test_exclusive_singles_drop_any_holder(tickets):
    seats = tickets([(1, "Single ", 9, THU), (1, "Flex", 9, SAT), (2, "Discount", 9, THU), (2, "Single ", 0, THU), (0, "Single ", 9, THU)])
    got = rows(marketing.monthly_single_revenue(seats, skip=0))
    assert [r["revenue"] for r in got] == [9.0]
    assert rows(marketing.monthly_single_revenue(seats, skip=1)) == []


def test_expenses_pivot_with_zeros(table):
    df = table([("1/5/2018", 10.0, "DigitalAds"), ("01/25/2018", 5.0, "DigitalAds"), ("2/1/2018", 1.0, "Promotions")],
               "date string, exp double, purpose string")
    jan, feb = rows(marketing.expense_matrix(df), "date")
    assert (jan["digital_ads"], jan["promotions"], feb["promotions"], feb["radio_and_tv"]) == (15.0, 0.0, 1.0, 0.0)


def test_promotions_count_missing_responses(table):
    df = table([("a", 1), ("a", None), ("a", 0), ("b", None)], "mt_desc string, response int")
    got = rows(marketing.promotion_conversion(df), "mt_desc")
    assert [(r["number_of_outreach"], r["number_of_conversions"]) for r in got] == [(3, 1), (1, 0)]


def test_performances_need_both_kinds_and_cap_singles(tickets):
    seats = tickets([(1, "Single ", 900, THU), (1, "Flex", 9, THU), (2, "Single ", 9, FRI), (1, "Flex", 9, SAT)])
    got = rows(revenue.per_performance(seats, "2019-03-01", cap=200))
    assert [(r["total_rev_singles"], r["total_rev_subs"]) for r in got] == [(200.0, 9.0)]
    series = rows(revenue.monthly_series(revenue.per_performance(seats, "2019-03-01"), "2019-01-01", "2019-02-01"),
                  "series_id", "month")
    assert [r["y"] for r in series] == [909.0, 0.0, 900.0, 0.0, 9.0, 0.0]


def test_revenue_mix_shares(tickets, table):
    seats = tickets([(1, "Single ", 30, THU), (1, "Flex", 10, THU), (0, "Flex", 99, THU)])
    gifts = donations(table, [(1, 1000, 2019), (2, 1000.01, 2019), (3, 5, 2013)])
    (got,) = rows(revenue.mix_aggregate(gifts, seats, revenue.season_labels(2018, 2019)))
    assert got["fy"] == "PS 18-19" and abs(got["earned_rev"] - 40 / 2040.01) < 1e-12
    (split,) = rows(revenue.mix_split(gifts, seats, ["PS 18-19"]))
    assert split["grp_c"] is None and split["single"] is None  # a missing band leaves the whole row unknown


def test_prospects_and_first_timers(tickets, table):
    pops = "PS 18-19 Pops"
    seats = tickets([(1, "Single ", 90, THU, None, pops)] * 9 + [(2, "Single ", 90, THU, None, pops)] * 9
                    + [(3, "Flex", 90, THU, None, pops)] * 9 + [(i, "Single ", 10, THU, None, pops) for i in range(10, 40)])
    got = audience.upgrade_prospects(seats, donations(table, [(2, 5, 2018)]), audience.AudienceRules(2019), "Pops")
    assert [(r["summary_cust_id"], r["cust_seg"]) for r in rows(got)] == [(1, "aficionado")]
    assert [r["summary_cust_id"] for r in rows(audience.first_time_subscribers(seats, 2019))] == [3]
    assert audience.series_seasons(2019, "Pops") == ["PS 17-18 Pops", "PS 18-19 Pops"]


def test_seat_finder_caps_on_all_tickets(tickets, table):
    seats = tickets([(1, "Flex", 9, THU), (2, "Flex", 9, THU), (2, "Flex", 9, SAT), (3, "Flex", 9, SAT)])
    names = table([(1, "Ann"), (2, "Bob")], "customer_no bigint, display_name string")
    got = rows(audience.seat_finder(audience.one_day(seats, "2019-01-31"), seats, names, audience.AudienceRules(2019, 1)))
    assert got == [{"summary_cust_id": 1, "summary_cust_name": "Ann", "seat": "A   1 - 7"}]


def test_concert_months_use_the_weekday_of_the_hall(tickets):
    # 03:00 UTC is the evening before in the hall: these are a Thursday, a Friday and a Saturday there.
    seats = tickets([(1, "Flex", 10, "2019-02-01 03:00:00"), (1, "Flex", 20, "2019-02-02 03:00:00"),
                     (1, "Flex", 30, "2019-02-03 03:00:00")])
    (row,) = rows(concert.revenue_monthly(seats, "2019-02-28"))
    assert (row["thursday"], row["friday"], row["saturday"]) == (10, 20, 30)
    assert rows(concert.revenue_monthly(seats, "2019-02-28", zone="UTC")) == []
