"""One statement per registered query that SQL can express."""

from __future__ import annotations

from houselights.oracle import fits, local, orders, smoothing
from houselights.oracle import tables as t

STATEMENTS: dict[str, str] = {}

POPS = ("PS 99-00 Pops", "PS 00-01 Pops")
CLASSICS = ("PS 99-00 Classics", "PS 00-01 Classics")
SEASONS = ("PS 96-97", "PS 97-98", "PS 98-99", "PS 99-00", "PS 00-01")


def put(name: str, body: str, *ctes: str, rounded: str = "", digits: int = 6) -> None:
    star = "*"
    if rounded:
        star += " REPLACE (" + ", ".join(f"round({col}, {digits}) AS {col}" for col in rounded.split()) + ")"
    recursive = "RECURSIVE " if any("_beta AS" in cte for cte in ctes) else ""
    prefix = f"WITH {recursive}" + ",".join(ctes) + "\n" if ctes else ""
    STATEMENTS[name] = f"{prefix}SELECT {star} FROM ({body}) result"


N = (t.TICKETS, t.NORMAL)
ND = (*N, t.DONATIONS, t.BANDS)

# --- weekday and zone ----------------------------------------------------------------------------------------

put("dow_revenue", "SELECT day_of_week, sum(paid_amt) AS rev FROM sold GROUP BY 1", *N, rounded="rev")
put("dow_sold_attended", """
SELECT day_of_week, 'tix_sold' AS category, count(*) AS count FROM sold WHERE kind <> 'Comp' GROUP BY 1
UNION ALL
SELECT day_of_week, 'attended', CAST(sum(came) AS BIGINT) FROM sold WHERE kind <> 'Comp' GROUP BY 1""", *N)
put("dow_comps", "SELECT day_of_week, count(*) AS count FROM sold WHERE kind = 'Comp' GROUP BY 1", *N)
put("dow_unsold", "SELECT day_of_week, count(*) AS count FROM normal WHERE kind = 'Unsold' GROUP BY 1", *N)
put("dow_subscribers", """
SELECT day_of_week, kind AS price_type_group, count(DISTINCT summary_cust_id) AS subscribers, sum(paid_amt) AS rev
FROM sold WHERE kind IN ('Subscription', 'Flex') GROUP BY 1, 2""", *N, rounded="rev")
for name, bands in (("dow_donors", "ABCDEFGH"), ("dow_donors_without_h", "ABCDEFG"), ("dow_donors_major", "ABCD")):
    put(name, f"""
SELECT day_of_week, donor_group, count(DISTINCT summary_cust_id) AS donors FROM sold_banded
WHERE donor_group IN {t.in_list(bands)} GROUP BY 1, 2""", *ND)
put("zone_revenue", "SELECT day_of_week, price_zone, sum(paid_amt) AS rev FROM sold GROUP BY 1, 2", *N, rounded="rev")
put("zone_sold", "SELECT day_of_week, price_zone, count(*) AS tix_sold FROM sold WHERE kind <> 'Comp' GROUP BY 1, 2", *N)
put("zone_percent_sold", """
SELECT day_of_week, price_zone, s / (s + u) AS percentage_sold
FROM (SELECT day_of_week, price_zone, count(*) AS s FROM sold WHERE kind <> 'Comp' GROUP BY 1, 2)
JOIN (SELECT day_of_week, price_zone, count(*) AS u FROM normal WHERE kind = 'Unsold' GROUP BY 1, 2)
  USING (day_of_week, price_zone)""", *N, rounded="percentage_sold")
put("zone_avg_price", """
SELECT day_of_week, price_zone, sum(paid_amt) / count(*) AS avg_price FROM sold WHERE kind <> 'Comp' GROUP BY 1, 2""",
    *N, rounded="avg_price")
put("zone_avg_price_singles", """
SELECT day_of_week, price_zone, sum(paid_amt) / count(*) AS avg_price FROM sold WHERE kind = 'Single' GROUP BY 1, 2""",
    *N, rounded="avg_price")
put("zone_comp_attendance", """
SELECT day_of_week, price_zone, 'comps' AS category, count(*) AS count FROM sold WHERE kind = 'Comp' GROUP BY 1, 2
UNION ALL
SELECT day_of_week, price_zone, 'attendance', CAST(sum(came) AS BIGINT) FROM sold WHERE kind = 'Comp' GROUP BY 1, 2""",
    *N)
put("zone_attendance_rate", """
SELECT day_of_week, price_zone, sum(came) / count(*) AS attendance FROM sold WHERE kind <> 'Comp' GROUP BY 1, 2""",
    *N, rounded="attendance")
for name, kind in (("zone_subscribers", "Subscription"), ("zone_flex_subscribers", "Flex")):
    put(name, f"""
SELECT day_of_week, price_zone, kind AS price_type_group, count(DISTINCT summary_cust_id) AS subscribers,
       sum(paid_amt) AS rev FROM sold WHERE kind = '{kind}' GROUP BY 1, 2, 3""", *N, rounded="rev")
put("zone_uniques_over_ranges", """
SELECT day_of_week, price_zone, kind AS price_type_group, count(DISTINCT summary_cust_id) AS customers, "first", "last"
FROM sold, (VALUES ('1996-01-01', '1996-12-31'), ('1996-07-01', '1997-06-30'), (NULL, NULL)) r("first", "last")
WHERE "first" IS NULL OR CAST(perf_dt AS DATE) BETWEEN CAST("first" AS DATE) AND CAST("last" AS DATE)
GROUP BY day_of_week, price_zone, kind, "first", "last" HAVING count(summary_cust_id) > 0""", *N)
put("zone_major_donors", """
SELECT day_of_week, price_zone, count(DISTINCT summary_cust_id) AS donors FROM sold_banded
WHERE donor_group IN ('A', 'B', 'C', 'D') GROUP BY 1, 2""", *ND)
for name, measure in (("monthly_dow_tix", "CAST(count(*) AS DOUBLE)"),
                      ("monthly_dow_revenue", "sum(paid_amt) / count(DISTINCT perf_dt)")):
    put(name, """
SELECT CAST(month AS VARCHAR) AS month, coalesce(max(v) FILTER (day_of_week = 'Thursday'), 0.0) AS thursday,
       coalesce(max(v) FILTER (day_of_week = 'Friday'), 0.0) AS friday,
       coalesce(max(v) FILTER (day_of_week = 'Saturday'), 0.0) AS saturday
FROM monthly FULL JOIN (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE)
                        AS month) spine USING (month)
GROUP BY 1""", *N, f"""
monthly AS (SELECT CAST(date_trunc('month', perf_dt) AS DATE) AS month, day_of_week, {measure} AS v
            FROM sold WHERE kind <> 'Comp' GROUP BY 1, 2)""", rounded="thursday friday saturday")
put("fy_dow_revenue", "SELECT fy, day_of_week, sum(paid_amt) AS rev FROM sold GROUP BY 1, 2", *N, rounded="rev")
put("subscriber_tenure", """
SELECT day_of_week, CASE WHEN years = 4 THEN '4+' ELSE CAST(years AS VARCHAR) END AS length_of_tenure,
       count(*) AS subscribers
FROM (SELECT day_of_week, summary_cust_id, count(DISTINCT fy) AS years FROM held
      WHERE (day_of_week, summary_cust_id) IN (SELECT (day_of_week, summary_cust_id) FROM held WHERE fy = 2001)
      GROUP BY 1, 2)
GROUP BY 1, 2""", *N, """
held AS (SELECT DISTINCT fy, day_of_week, summary_cust_id FROM sold
         WHERE kind = 'Subscription' AND fy BETWEEN 1998 AND 2001)""")
put("percent_potential_revenue", """
SELECT day_of_week, price_zone, earned / (available * standard_price) AS percentage
FROM (SELECT day_of_week, price_zone, sum(paid_amt) AS earned FROM sold GROUP BY 1, 2)
JOIN (SELECT day_of_week, price_zone, count(*) AS available FROM normal GROUP BY 1, 2) USING (day_of_week, price_zone)
LEFT JOIN prices USING (day_of_week, price_zone)""", *N, t.PRICES, rounded="percentage")
for name, only in (("sell_type_mix", "true"), ("sell_type_mix_singles", "kind NOT IN ('Subscription', 'Flex')")):
    put(name, """
SELECT day_of_week, price_zone, sell_type, n / total AS percent_sold
FROM typed JOIN (SELECT day_of_week, price_zone, sum(n) AS total FROM typed GROUP BY 1, 2) USING (day_of_week, price_zone)""",
        *N, t.PRICES, f"""
typed AS (
  SELECT day_of_week, price_zone,
         CASE WHEN kind = 'Comp' THEN 'Comp' WHEN standard_price IS NULL THEN NULL
              WHEN standard_price > paid_amt THEN 'Discount' ELSE 'Full' END AS sell_type, count(*) AS n
  FROM sold LEFT JOIN prices USING (day_of_week, price_zone) WHERE {only} GROUP BY 1, 2, 3)""", rounded="percent_sold")

# --- audience ------------------------------------------------------------------------------------------------

for name, which in (("age_group_summary_classics", "Classics"), ("age_group_summary_pops", "Pops")):
    put(name, """
SELECT age_group, price_type_group, count(*) AS unique_customers, CAST(sum(tix) AS BIGINT) AS tix_transactions,
       round(sum(paid), 2) AS paid_amt, round(sum(given), 2) AS total_donations_5yr, round(sum(given), 2) / count(*) AS average_donations_5yr,
       max(given) AS max_5yr_donation_amt, CAST(sum(came) AS BIGINT) AS attended,
       round(sum(paid), 2) / sum(tix) AS average_ticket_price, round(sum(given), 2) / count(*) / 5 AS average_annual_donation,
       sum(came) / sum(tix) AS attendance_rate
FROM (SELECT age_group, price_type_group, b.summary_cust_id, count(*) AS tix, sum(paid_amt) AS paid,
             max(coalesce(total_gift, 0.0)) AS given, sum(CASE WHEN attended = 'Attended' THEN 1 ELSE 0 END) AS came
      FROM buys b JOIN ages USING (summary_cust_id) LEFT JOIN giving USING (summary_cust_id) GROUP BY 1, 2, 3)
GROUP BY 1, 2""", t.TICKETS, t.DONATIONS, t.BIRTHS, f"""
subs AS (SELECT DISTINCT summary_cust_id FROM tickets
         WHERE season_desc IN ('PS 00-01 Classics', 'PS 00-01 Pops') AND paid_amt > 0 AND summary_cust_id <> 0
           AND price_type_group = 'Subscription'),
buys AS (SELECT * FROM tickets WHERE season_desc = 'PS 00-01 {which}' AND paid_amt > 0 AND summary_cust_id <> 0
           AND perf_dt <= TIMESTAMP '2001-06-30'
           AND NOT (price_type_group = 'Single ' AND summary_cust_id IN (SELECT summary_cust_id FROM subs))),
ages AS (SELECT summary_cust_id, CASE WHEN key_value <= 1954 THEN 'group_65_and_older'
                WHEN key_value <= 1974 THEN 'group_45_to_64' ELSE 'under_44' END AS age_group
         FROM births WHERE key_value > 0)""",
        rounded="average_donations_5yr average_annual_donation average_ticket_price attendance_rate max_5yr_donation_amt",
        digits=8)

AGE = """CASE WHEN age <= 19 THEN 'less20' WHEN age <= 29 THEN 'twenties' WHEN age <= 39 THEN 'thirties'
         WHEN age <= 49 THEN 'fourties' WHEN age <= 59 THEN 'fifties' WHEN age <= 69 THEN 'sixties'
         WHEN age <= 79 THEN 'seventies' WHEN age <= 89 THEN 'eighties' WHEN age <= 99 THEN 'nineties'
         WHEN age IS NOT NULL THEN 'hundreds' END"""
put("age_by_dow", """
SELECT dow, age_grp, count, count / total AS percent
FROM counts JOIN (SELECT dow, sum(count) AS total FROM counts GROUP BY 1) USING (dow)""", t.TICKETS, t.BIRTHS, f"""
counts AS (
  SELECT dow, {AGE} AS age_grp, count(*) AS count
  FROM (SELECT DISTINCT summary_cust_id, dayname(perf_dt) AS dow FROM tickets
        WHERE paid_amt <> 0 AND summary_cust_id <> 0 AND dayname(perf_dt) IN ('Thursday', 'Friday', 'Saturday'))
  JOIN (SELECT summary_cust_id, 2001 - key_value AS age FROM births WHERE key_value <> 0) USING (summary_cust_id)
  GROUP BY 1, 2)""", rounded="percent")
put("customer_flow", """
SELECT total_perfs, count(*) AS total_customers
FROM (SELECT summary_cust_id, count(DISTINCT perf_dt) AS total_perfs FROM tickets
      WHERE summary_cust_id > 0 AND price_type_group <> 'Comp' AND summary_cust_id <> 2
        AND perf_dt <= (SELECT perf_dt FROM numbers WHERE concert_number = 400)
        AND summary_cust_id NOT IN (SELECT summary_cust_id FROM tickets
              WHERE summary_cust_id > 0 AND price_type_group IN ('Flex', 'Subscription'))
      GROUP BY 1)
GROUP BY 1""", t.TICKETS, """
numbers AS (SELECT perf_dt, row_number() OVER (ORDER BY perf_dt) AS concert_number
            FROM (SELECT DISTINCT perf_dt FROM tickets))""")
MIX_SETS = """
tix AS (SELECT summary_cust_id, fy, price_type_group IN ('Subscription', 'Flex') AS sub FROM tickets
        WHERE summary_cust_id > 0 AND perf_dt <= TIMESTAMP '2000-12-31'),
mixed AS (
  SELECT summary_cust_id, 'subscriber' AS buyer,
         CASE WHEN summary_cust_id NOT IN (SELECT summary_cust_id FROM tix WHERE fy IN (1998, 1999, 2000) AND sub) THEN 'new'
              WHEN summary_cust_id IN (SELECT summary_cust_id FROM tix WHERE fy = 2000 AND sub)
                   AND summary_cust_id NOT IN (SELECT summary_cust_id FROM tix WHERE fy IN (1998, 1999) AND sub)
                THEN 'second_year' ELSE 'multi' END AS class
  FROM (SELECT DISTINCT summary_cust_id FROM tix WHERE fy = 2001 AND sub)
  UNION ALL
  SELECT summary_cust_id, 'single',
         CASE WHEN summary_cust_id IN (SELECT summary_cust_id FROM tix WHERE fy IN (1998, 1999, 2000)) THEN 'known'
              ELSE 'new' END
  FROM (SELECT DISTINCT summary_cust_id FROM tix WHERE fy = 2001
        EXCEPT SELECT DISTINCT summary_cust_id FROM tix WHERE fy = 2001 AND sub))"""
put("audience_mix", "SELECT * FROM mixed", t.TICKETS, MIX_SETS)
put("audience_mix_counts", "SELECT buyer, class, count(*) AS customers FROM mixed GROUP BY 1, 2", t.TICKETS, MIX_SETS)
put("single_buyers", "SELECT summary_cust_id FROM mixed WHERE buyer = 'single'", t.TICKETS, MIX_SETS)
put("customer_frequency_value", "SELECT * FROM valued", t.TICKETS, t.customer_values(POPS),
    rounded="avg_paid_amt tot_paid_amt", digits=8)
put("customer_frequency_value_classics", "SELECT * FROM valued", t.TICKETS, t.customer_values(CLASSICS),
    rounded="avg_paid_amt tot_paid_amt", digits=8)
put("customer_frequency_value_all", "SELECT * FROM valued", t.TICKETS, t.customer_values(),
    rounded="avg_paid_amt tot_paid_amt", digits=8)
put("customer_segments", "SELECT * FROM segments", t.TICKETS, t.customer_values(), t.segmented(),
    rounded="avg_paid_amt tot_paid_amt", digits=8)
put("audience_key_sets", """
SELECT summary_cust_id, 'renew' AS key_set FROM renew_keys UNION ALL
SELECT summary_cust_id, 'return' FROM return_keys UNION ALL SELECT summary_cust_id, 'subscriber' FROM sub_keys""",
    t.TICKETS, t.customer_values(), t.KEY_SETS)

ONE_DAY = """
attendees AS (SELECT DISTINCT DATE '2001-04-26' AS concert_date, summary_cust_id FROM good
              WHERE perf_dt > TIMESTAMP '2001-04-26' AND perf_dt < TIMESTAMP '2001-04-27')"""
ALL_DAYS = """
attendees AS (SELECT DISTINCT CAST(perf_dt AS DATE) AS concert_date, summary_cust_id FROM good WHERE fy = 2001)"""
AUD = (t.KEY_SETS, t.DONATIONS, t.segmented())
put("concert_audience", "SELECT * REPLACE (CAST(concert_date AS VARCHAR) AS concert_date) FROM audience",
    t.TICKETS, t.customer_values(POPS), *AUD, ONE_DAY, t.AUDIENCE, rounded="donor_5yr_history")
put("concert_audience_season", "SELECT * REPLACE (CAST(concert_date AS VARCHAR) AS concert_date) FROM audience",
    t.TICKETS, t.customer_values(first_fy=2000), *AUD, ALL_DAYS, t.AUDIENCE, rounded="donor_5yr_history")
put("concert_audience_this_year_gifts", "SELECT * REPLACE (CAST(concert_date AS VARCHAR) AS concert_date) FROM audience",
    t.TICKETS, t.customer_values(first_fy=2000), t.KEY_SETS, t.DONATIONS.replace("FROM donations GROUP", "FROM donations WHERE cont_fy >= 2001 GROUP"),
    t.segmented(), ALL_DAYS, t.AUDIENCE, rounded="donor_5yr_history")
put("audience_counts", """
SELECT CAST(concert_date AS VARCHAR) AS concert_date, dimension, level, count(*) AS count
FROM (SELECT concert_date, 'classification' AS dimension, classification AS level FROM audience UNION ALL
      SELECT concert_date, 'type', CASE WHEN subscriber = 1 THEN 'subscriber' ELSE 'single' END FROM audience UNION ALL
      SELECT concert_date, 'segment', segment FROM audience UNION ALL
      SELECT concert_date, 'donor_group', donor_group FROM audience)
GROUP BY 1, 2, 3""", t.TICKETS, t.customer_values(first_fy=2000), *AUD, ALL_DAYS, t.AUDIENCE)
put("seat_finder", """
SELECT summary_cust_id, c_name AS summary_cust_name,
       section || '   ' || "row" || ' - ' || seat AS seat
FROM tickets LEFT JOIN customer ON c_custkey = summary_cust_id
WHERE summary_cust_id > 0 AND paid_amt > 5 AND perf_dt > TIMESTAMP '2001-04-26' AND perf_dt < TIMESTAMP '2001-04-27'
  AND summary_cust_id IN (SELECT summary_cust_id FROM tickets GROUP BY 1 HAVING count(*) <= 40)""", t.TICKETS)
put("seats_within_cap", """
SELECT summary_cust_id, count(*) AS seats FROM tickets WHERE summary_cust_id > 0 GROUP BY 1 HAVING count(*) <= 40""",
    t.TICKETS)
put("performance_numbers", """
SELECT strftime(perf_dt, '%Y-%m-%d %H:%M:%S') AS perf_dt, row_number() OVER (ORDER BY perf_dt) AS concert_number
FROM (SELECT DISTINCT perf_dt FROM tickets)""", t.TICKETS)
put("latest_year_seats", """
SELECT fy, price_type_group, count(*) AS seats, sum(paid_amt) AS paid FROM tickets
WHERE fy >= (SELECT max(fy) FROM tickets) - 1 GROUP BY 1, 2""", t.TICKETS, rounded="paid")
put("sub_flex_by_fy", """
SELECT 'fy' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS fy,
       nullif(count(*) FILTER (price_type_group = 'Flex'), 0) AS flex,
       nullif(count(*) FILTER (price_type_group = 'Subscription'), 0) AS subscription
FROM tickets WHERE price_type_group IN ('Subscription', 'Flex') GROUP BY 1""", t.TICKETS)
put("first_time_subscribers", """
SELECT summary_cust_id, true AS new_sub FROM (
  SELECT DISTINCT summary_cust_id FROM paid_subs WHERE fy = 2001 EXCEPT
  SELECT DISTINCT summary_cust_id FROM paid_subs WHERE fy = 2000)""", t.TICKETS, """
paid_subs AS (SELECT * FROM tickets WHERE price_type_group IN ('Subscription', 'Flex') AND summary_cust_id <> 0
              AND paid_amt > 0)""")
for name, seasons in (("upgrade_prospects_classics", CLASSICS), ("upgrade_prospects_pops", POPS)):
    put(name, """
SELECT summary_cust_id, freq, avg_paid_amt, tot_paid_amt,
       CASE segment WHEN 'Aficionado' THEN 'aficionado' WHEN 'High-value regular' THEN 'high value regular'
            ELSE 'high value prospect' END AS cust_seg,
       summary_cust_id IN (SELECT summary_cust_id FROM now_subs) AS subscriber, coalesce(total_gift, 0.0) AS total_gift
FROM segments LEFT JOIN giving USING (summary_cust_id)
WHERE coalesce(total_gift, 0.0) = 0 AND segment IN ('Aficionado', 'High-value regular', 'High-value prospect')
  AND NOT (summary_cust_id IN (SELECT summary_cust_id FROM now_subs)
           AND summary_cust_id NOT IN (SELECT summary_cust_id FROM old_subs))""", t.TICKETS, t.DONATIONS, f"""
mine AS (SELECT * FROM tickets WHERE season_desc IN {t.in_list(seasons)} AND summary_cust_id > 0),
now_subs AS (SELECT DISTINCT summary_cust_id FROM mine
             WHERE price_type_group IN ('Subscription', 'Flex') AND paid_amt > 0 AND fy = 2001),
old_subs AS (SELECT DISTINCT summary_cust_id FROM mine
             WHERE price_type_group IN ('Subscription', 'Flex') AND paid_amt > 0 AND fy = 2000),
valued AS (SELECT summary_cust_id, count(*) AS freq, sum(paid_amt) / count(*) AS avg_paid_amt, sum(paid_amt) AS tot_paid_amt
           FROM mine WHERE paid_amt > 5
             AND summary_cust_id IN (SELECT summary_cust_id FROM mine GROUP BY 1 HAVING count(*) <= 40) GROUP BY 1)""",
        t.segmented(), rounded="avg_paid_amt tot_paid_amt total_gift", digits=8)

# --- concerts ------------------------------------------------------------------------------------------------

RATIOS = "sub_avg sub_rev sgl_avg sgl_rev prcnt_sold tot_rev prcnt_comp comp_att sub_att sgl_att tot_att"
DAY = """
concert AS (SELECT * FROM tickets WHERE perf_dt > TIMESTAMP '2001-04-26' AND perf_dt < TIMESTAMP '2001-04-27')"""
put("performance_summary", "SELECT * FROM summary", t.TICKETS, t.summary("tickets"), rounded=RATIOS, digits=8)
put("performance_revenue_view", """
SELECT perf_dt, zone, seats, sub_sold, sub_avg, sub_rev, sgl_sold, sgl_avg, sgl_rev, tot_sold, prcnt_sold, tot_rev
FROM summary""", t.TICKETS, DAY, t.summary("concert"), rounded="sub_avg sub_rev sgl_avg sgl_rev prcnt_sold tot_rev", digits=8)
put("performance_comp_view", "SELECT perf_dt, zone, seats, tot_comp, prcnt_comp FROM summary",
    t.TICKETS, DAY, t.summary("concert"), rounded="prcnt_comp", digits=8)
put("performance_attendance_view", "SELECT perf_dt, zone, seats, att, comp_att, sub_att, sgl_att, tot_att FROM summary",
    t.TICKETS, DAY, t.summary("concert"), rounded="comp_att sub_att sgl_att tot_att", digits=8)
MONEY, RATES = "sub_avg sub_rev sgl_avg sgl_rev tot_rev", "prcnt_sold prcnt_comp comp_att sub_att sgl_att tot_att"
put("performance_formatted", "SELECT * REPLACE (" + ", ".join(
    [f"format('${{:,.2f}}', {x}) AS {x}" for x in MONEY.split()]
    + [f"format('{{:,.1f}}%', {x} * 100) AS {x}" for x in RATES.split()]) + ") FROM summary", t.TICKETS, t.summary("tickets"))
CONCERT_MONTHS = """
daily AS (SELECT perf_dt, sum(paid_amt) AS paid FROM tickets
          WHERE summary_cust_id IS NOT NULL AND perf_dt < TIMESTAMP '2001-07-01' GROUP BY 1),
concert_months AS (
  SELECT strftime(perf_dt, '%Y-%m') AS date, avg(paid) FILTER (dayname(perf_dt) = 'Thursday') AS thursday,
         avg(paid) FILTER (dayname(perf_dt) = 'Friday') AS friday,
         avg(paid) FILTER (dayname(perf_dt) = 'Saturday') AS saturday
  FROM daily GROUP BY 1)"""
COMPLETE = "SELECT * FROM concert_months WHERE thursday IS NOT NULL AND friday IS NOT NULL AND saturday IS NOT NULL"
put("concert_revenue_monthly", COMPLETE, t.TICKETS, CONCERT_MONTHS, rounded="thursday friday saturday")
put("concert_revenue_annual", f"""
SELECT substr(date, 1, 4) AS year, avg(thursday) AS thursday, avg(friday) AS friday, avg(saturday) AS saturday
FROM ({COMPLETE}) GROUP BY 1""", t.TICKETS, CONCERT_MONTHS, rounded="thursday friday saturday")

# --- donors --------------------------------------------------------------------------------------------------

put("major_donor_friday_subs", """
SELECT m.summary_cust_id, total_gift, tix, attendance, total_paid_amt, attendance / tix AS attendance_rate,
       c_name AS display_name
FROM (SELECT summary_cust_id, sum(gift_plus_pledge) AS total_gift FROM donations WHERE cont_fy = 2000
      GROUP BY 1 HAVING sum(gift_plus_pledge) >= 2500) m
JOIN (SELECT summary_cust_id, count(*) AS tix,
             CAST(sum(CASE WHEN attended = 'Attended' THEN 1 ELSE 0 END) AS BIGINT) AS attendance,
             sum(paid_amt) AS total_paid_amt
      FROM tickets WHERE perf_dt < TIMESTAMP '2001-06-30' AND dayname(perf_dt) IN ('Friday', 'Tuesday')
        AND price_type_group = 'Subscription' AND summary_cust_id IS NOT NULL GROUP BY 1) s USING (summary_cust_id)
LEFT JOIN customer ON c_custkey = m.summary_cust_id""", t.TICKETS, t.DONATIONS,
    rounded="total_gift total_paid_amt attendance_rate")
put("donor_retention", """
SELECT grp, fy, lost, downgrade, maintain, upgrade, downgrade + maintain + upgrade AS total_retention
FROM (SELECT p.band AS grp, y.fy,
             count(*) FILTER (c.band IS NULL) / count(*) AS lost,
             count(*) FILTER (c.band < p.band) / count(*) AS downgrade,
             count(*) FILTER (c.band = p.band) / count(*) AS maintain,
             count(*) FILTER (c.band > p.band) / count(*) AS upgrade
      FROM yearly p JOIN years o ON p.fy = o.fy JOIN years y ON y.ord = o.ord + 1
      LEFT JOIN yearly c ON c.summary_cust_id = p.summary_cust_id AND c.fy = y.fy
      GROUP BY 1, 2)""", t.DONATIONS, """
yearly AS (
  SELECT summary_cust_id, cont_fy AS fy,
         CASE WHEN sum(gift_plus_pledge) < 1000 THEN 'A' WHEN sum(gift_plus_pledge) < 10000 THEN 'B'
              WHEN sum(gift_plus_pledge) < 100000 THEN 'C' ELSE 'D' END AS band
  FROM donations GROUP BY 1, 2),
years AS (SELECT fy, row_number() OVER (ORDER BY fy) AS ord FROM (SELECT DISTINCT fy FROM yearly))""",
    rounded="lost downgrade maintain upgrade total_retention")
put("legacy_donors", """
SELECT d.*, CAST(key_value AS BIGINT) AS birth_yr, CASE WHEN key_value > 0 THEN CAST(2001 - key_value AS BIGINT) END AS age,
       segment, CASE WHEN k.summary_cust_id IS NOT NULL THEN CAST(1 AS BIGINT) END AS subscriber
FROM (SELECT summary_cust_id, coalesce(sum(gift_plus_pledge) FILTER (cont_fy = 2001), 0.0) AS amt_cy,
             coalesce(sum(gift_plus_pledge) FILTER (cont_fy = 2000), 0.0) AS amt_py,
             coalesce(sum(gift_plus_pledge) FILTER (cont_fy BETWEEN 1997 AND 2001), 0.0) AS amt_last5yrs,
             coalesce(sum(gift_plus_pledge) FILTER (cont_fy BETWEEN 1991 AND 1996), 0.0)
               + coalesce(sum(gift_plus_pledge) FILTER (cont_fy BETWEEN 1997 AND 2001), 0.0) AS amt_last10yrs,
             max(cont_fy) AS most_recent_cont_yr
      FROM donations WHERE cont_fy <= 2001 GROUP BY 1) d
LEFT JOIN births USING (summary_cust_id) LEFT JOIN segments USING (summary_cust_id)
LEFT JOIN sub_keys k USING (summary_cust_id)""".replace(
    "segment, CASE", "segments.segment, CASE"), t.TICKETS, t.DONATIONS, t.BIRTHS, t.customer_values(), t.KEY_SETS,
    t.segmented(), rounded="amt_cy amt_py amt_last5yrs amt_last10yrs")
put("giving_band_rules", """
SELECT summary_cust_id, donor_group AS band_8,
       CASE WHEN total_gift < 1000 THEN 'A' WHEN total_gift < 10000 THEN 'B' WHEN total_gift < 100000 THEN 'C'
            ELSE 'D' END AS band_4_below,
       CASE WHEN total_gift <= 1000 THEN 'A' WHEN total_gift <= 10000 THEN 'B' WHEN total_gift <= 100000 THEN 'C'
            ELSE 'D' END AS band_4_up_to
FROM giving JOIN bands USING (summary_cust_id)""", *ND)
LABEL = "'PS ' || lpad(CAST((cont_fy - 1) % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(cont_fy % 100 AS VARCHAR), 2, '0')"
put("revenue_mix_aggregate", f"""
SELECT fy, c / (c + e) AS contributed_rev, e / (c + e) AS earned_rev
FROM (SELECT {LABEL} AS fy, sum(gift_plus_pledge) AS c FROM donations GROUP BY 1)
LEFT JOIN (SELECT substr(season_desc, 1, 8) AS fy, sum(paid_amt) AS e FROM tickets
           WHERE summary_cust_id > 0 AND paid_amt > 0 GROUP BY 1) USING (fy)
WHERE fy IN {t.in_list(SEASONS)}""", t.TICKETS, t.DONATIONS, rounded="contributed_rev earned_rev")
put("revenue_mix_split", f"""
SELECT fy, a / total AS grp_a, b / total AS grp_b, c / total AS grp_c, d / total AS grp_d, s / total AS single,
       u / total AS subscription
FROM (SELECT *, a + b + c + d + s + u AS total
      FROM (SELECT fy, sum(g) FILTER (g <= 1000) AS a, sum(g) FILTER (g > 1000 AND g <= 10000) AS b,
                   sum(g) FILTER (g > 10000 AND g <= 100000) AS c, sum(g) FILTER (g > 100000) AS d
            FROM (SELECT {LABEL} AS fy, summary_cust_id, sum(gift_plus_pledge) AS g FROM donations GROUP BY 1, 2)
            GROUP BY 1)
      LEFT JOIN (SELECT substr(season_desc, 1, 8) AS fy,
                        sum(paid_amt) FILTER (price_type_group IN ('Single ', 'Discount')) AS s,
                        sum(paid_amt) FILTER (price_type_group NOT IN ('Single ', 'Discount')) AS u
                 FROM tickets WHERE summary_cust_id > 0 AND paid_amt > 0 GROUP BY 1) USING (fy))
WHERE fy IN {t.in_list(SEASONS)}""", t.TICKETS, t.DONATIONS,
    rounded="grp_a grp_b grp_c grp_d single subscription")

# --- web -----------------------------------------------------------------------------------------------------

CHANNEL = """
       count(*) FILTER (opens) AS sessions, count(*) FILTER (event_type = 'view') AS pageviews,
       count(*) FILTER (opens AND closes) AS bounces,
       coalesce(sum(stay), 0.0) / nullif(count(*) FILTER (opens), 0) AS avg_session_duration,
       count(*) FILTER (event_type = 'purchase') AS transactions,
       coalesce(sum(value) FILTER (event_type = 'purchase'), 0.0) AS transaction_revenue,
       coalesce(sum(value) FILTER (event_type IN ('purchase', 'signup')), 0.0) AS total_value,
       coalesce(sum(value) FILTER (event_type = 'purchase'), 0.0) AS item_revenue"""
CHANNEL_ROUNDED = "avg_session_duration transaction_revenue total_value item_revenue"
VIEWS_ONCE = "count(DISTINCT CASE WHEN event_type = 'view' THEN user_id || '#' || sno || '#' || page END)"
put("channel_report_by_date", f"""
SELECT first_channel AS channel, CAST(first_date AS VARCHAR) AS date, {CHANNEL} FROM sess GROUP BY 1, 2""",
    t.HITS, t.sessions(), rounded=CHANNEL_ROUNDED, digits=4)
put("channel_report", f"""
SELECT first_channel AS channel, {CHANNEL} FROM sess WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-29' GROUP BY 1""",
    t.HITS, t.sessions(), rounded=CHANNEL_ROUNDED, digits=4)
put("page_report", f"""
SELECT page, count(*) FILTER (opens) AS sessions, count(*) FILTER (opens AND closes) AS bounces,
       count(*) FILTER (closes) AS exits, round(sum(stay), 6) / nullif(count(stay), 0) AS avg_time_on_page,
       coalesce(sum(value) FILTER (event_type IN ('purchase', 'signup')), 0.0) / nullif({VIEWS_ONCE}, 0) AS page_value
FROM sess GROUP BY 1""", t.HITS, t.sessions(), rounded="avg_time_on_page page_value", digits=6)
put("arrivals_by_age", """
SELECT first_channel AS channel, age_bracket, count(*) FILTER (opens) AS sessions FROM sess GROUP BY 1, 2""",
    t.HITS, t.sessions())
put("transactions_by_age", """
SELECT age_bracket, count(*) FILTER (event_type = 'purchase') AS transactions,
       coalesce(sum(value) FILTER (event_type = 'purchase'), 0.0) AS transaction_revenue FROM hits GROUP BY 1""",
    t.HITS, rounded="transaction_revenue")
put("top_exit_pages", """
SELECT page, age_bracket, coalesce(n, 0) AS sessions
FROM (SELECT page FROM exits GROUP BY 1 ORDER BY sum(n) DESC, page LIMIT 10)
CROSS JOIN (SELECT DISTINCT age_bracket FROM hits) LEFT JOIN exits USING (page, age_bracket)""", t.HITS, t.sessions(), """
exits AS (SELECT page, age_bracket, count(*) AS n FROM sess WHERE closes GROUP BY 1, 2)""")
put("top_ad_groups", """
SELECT ad_group, impressions, 1000 * cost / nullif(impressions, 0) AS cpm, ad_clicks, cost / nullif(ad_clicks, 0) AS cpc,
       total_value, revenue / nullif(ad_clicks, 0) AS rpc, 100 * revenue / cost AS roas
FROM (SELECT ad_group, count(*) FILTER (event_type = 'view') AS impressions,
             count(*) FILTER (event_type = 'click') AS ad_clicks,
             coalesce(sum(value * 0.01) FILTER (event_type = 'click'), 0.0) AS cost,
             coalesce(sum(value) FILTER (event_type = 'purchase'), 0.0) AS revenue,
             coalesce(sum(value) FILTER (event_type IN ('purchase', 'signup')), 0.0) AS total_value
      FROM hits WHERE ad_group IS NOT NULL GROUP BY 1)
WHERE cost > 0 ORDER BY roas DESC, ad_group LIMIT 20""", t.HITS, rounded="cpm cpc total_value rpc roas")
put("peak_social_days", """
SELECT CAST(date AS VARCHAR) AS date, n AS social_interactions FROM days WHERE n = (SELECT max(n) FROM days)""", t.HITS, """
days AS (SELECT date, count(*) FILTER (event_type = 'signup') AS n FROM hits GROUP BY 1)""")
put("monthly_web_value", """
SELECT CAST(CAST(date_trunc('month', report_date) AS DATE) AS VARCHAR) AS month,
       coalesce(sum(value) FILTER (event_type IN ('purchase', 'signup')), 0.0) AS total_value,
       count(*) FILTER (event_type = 'view' AND ad_group IS NOT NULL) AS impressions FROM hits GROUP BY 1""",
    t.HITS, rounded="total_value")
DAILY = f"""
       coalesce(sum(stay), 0.0) / nullif(count(*) FILTER (opens), 0) AS avg_session_duration,
       {VIEWS_ONCE} AS unique_page_views,
       count(*) FILTER (event_type = 'view' AND ad_group IS NOT NULL) AS impressions,
       round(sum(stay), 6) / nullif(count(stay), 0) AS avg_time_on_page,
       coalesce(sum(value * 0.01) FILTER (event_type = 'click' AND ad_group IS NOT NULL), 0.0) AS ad_cost,
       count(*) FILTER (is_new) AS new_users,
       count(*) FILTER (is_new) / nullif(count(*) FILTER (opens), 0) AS percent_new_sessions,
       coalesce(sum(value) FILTER (event_type IN ('purchase', 'signup')), 0.0) AS total_value"""
put("daily_web_backfill", """
SELECT *, CASE WHEN new_users > 0 THEN ln(new_users) END AS log_new_users FROM daily""", t.HITS, t.sessions(), f"""
daily AS (SELECT CAST(date AS VARCHAR) AS date, {DAILY} FROM sess
          WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-12' OR date BETWEEN DATE '2024-01-15' AND DATE '2024-01-28'
          GROUP BY 1)""",
    rounded="avg_session_duration avg_time_on_page ad_cost percent_new_sessions total_value log_new_users", digits=4)
put("ad_costs_by_device", """
SELECT device, CAST(date AS VARCHAR) AS date, ad_clicks, ad_cost, new_users, 100 * revenue / nullif(ad_cost, 0) AS roas
FROM (SELECT device, date, count(*) FILTER (event_type = 'click' AND ad_group IS NOT NULL) AS ad_clicks,
             coalesce(sum(value * 0.01) FILTER (event_type = 'click' AND ad_group IS NOT NULL), 0.0) AS ad_cost,
             count(*) FILTER (is_new) AS new_users,
             coalesce(sum(value) FILTER (event_type = 'purchase'), 0.0) AS revenue FROM sess GROUP BY 1, 2)""".replace(
    "ad_clicks, ad_cost, new_users, 100 * revenue / nullif(ad_cost, 0) AS roas",
    "ad_clicks, ad_cost, new_users, 100 * revenue / nullif(ad_cost, 0) AS roas"), t.HITS, t.sessions(),
    rounded="ad_cost roas")

# --- marketing -----------------------------------------------------------------------------------------------

put("promotion_conversion", """
SELECT 'M' || CAST(event_id % 7 AS VARCHAR) AS mt_desc, count(*) AS number_of_outreach,
       count(*) FILTER (event_type = 'purchase') AS number_of_conversions,
       count(*) FILTER (event_type = 'purchase') / count(*) AS conv_perc FROM events GROUP BY 1""", rounded="conv_perc")
SM = (t.TICKETS, t.SINGLES, t.SINGLE_MONTHS)
put("monthly_single_revenue", "SELECT CAST(date AS VARCHAR) AS date, revenue FROM single_months", *SM, rounded="revenue")
put("performances_per_month", "SELECT CAST(date AS VARCHAR) AS date, performances FROM perf_months",
    t.TICKETS, t.PERF_MONTHS)
PURPOSES = "digital_ads direct_mail email_services print_media print_production promotions radio_and_tv"
put("monthly_expense_matrix", "SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM expense_months",
    t.EXPENSES, t.EXPENSE_MONTHS, rounded=PURPOSES)
MIXED = (*SM, t.PERF_MONTHS, t.EXPENSES, t.EXPENSE_MONTHS, t.HITS, t.sessions(), t.WEB_MONTHS, t.MIX)
MIX_ROUNDED = f"revenue {PURPOSES} transaction_revenue print_total rev_per_performance"
put("marketing_mix_table", "SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM mix", *MIXED, rounded=MIX_ROUNDED)
BAND = """
band AS (SELECT * FROM mix WHERE revenue < 1.1 * (SELECT avg(revenue) FROM mix) AND revenue > 0.7 * (SELECT avg(revenue) FROM mix))"""
put("marketing_mix_band", """
SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM band""", *MIXED, BAND,
    rounded=MIX_ROUNDED)
put("marketing_fit_lines", """
SELECT pair, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, CAST(regr_count(y, x) AS BIGINT) AS n
FROM (SELECT 'log_digital_ads_log_sessions' AS pair, ln(nullif(digital_ads, 0)) AS x, ln(nullif(sessions, 0)) AS y FROM band
      UNION ALL SELECT 'log_print_sessions', ln(nullif(print_total, 0)), CAST(sessions AS DOUBLE) FROM band
      UNION ALL SELECT 'log_direct_mail_sessions', ln(nullif(direct_mail, 0)), CAST(sessions AS DOUBLE) FROM band
      UNION ALL SELECT 'log_radio_tv_sessions', ln(nullif(radio_and_tv, 0)), CAST(sessions AS DOUBLE) FROM band
      UNION ALL SELECT 'log_sessions_sessions', ln(nullif(sessions, 0)), CAST(sessions AS DOUBLE) FROM band)
GROUP BY 1""", *MIXED, BAND, rounded="slope intercept r2")
AB = """
outcomes AS (
  SELECT CASE WHEN o_custkey % 4 <> 0 THEN 'receive' ELSE 'no_receive' END AS variant,
         CASE WHEN o_totalprice > CASE WHEN o_custkey % 4 <> 0 THEN 420000 ELSE 425000 END THEN 1 ELSE 0 END AS converted
  FROM orders),
posterior AS (
  SELECT variant, n AS size, CAST(a AS BIGINT) AS conversions, a / n AS rate, a / n AS posterior_mean,
         CAST(a AS DOUBLE) * (n - a) / (pow(n, 2) * (n + 1)) AS posterior_variance
  FROM (SELECT variant, count(*) AS n, sum(converted) AS a FROM outcomes GROUP BY 1)),
intervals AS (SELECT *, posterior_mean - 1.959964 * sqrt(posterior_variance) AS low,
                     posterior_mean + 1.959964 * sqrt(posterior_variance) AS high FROM posterior)"""
put("ab_conversion", "SELECT * FROM intervals", AB, rounded="rate posterior_mean posterior_variance low high")
put("ab_separated", """
SELECT r.low AS better_low, n.high AS worse_high, r.low > n.high AS is_separated
FROM intervals r, intervals n WHERE r.variant = 'receive' AND n.variant = 'no_receive'""", AB,
    rounded="better_low worse_high")

# --- baskets -------------------------------------------------------------------------------------------------

ITEMS = (t.TICKETS, t.SINGLES, t.PERFORMANCES, """
items AS (SELECT DISTINCT summary_cust_id, name FROM singles JOIN performances USING (perf_dt)),
total AS (SELECT count(DISTINCT summary_cust_id) AS n FROM items)""")
put("baskets", "SELECT summary_cust_id, string_agg(name, '|' ORDER BY name) AS items FROM items GROUP BY 1", *ITEMS)
put("frequent_itemsets", """
SELECT items, freq, freq / n AS support
FROM (SELECT a.name || '|' || b.name AS items, count(*) AS freq FROM items a JOIN items b
        ON a.summary_cust_id = b.summary_cust_id AND a.name < b.name GROUP BY 1
      UNION ALL
      SELECT a.name || '|' || b.name || '|' || c.name, count(*) FROM items a JOIN items b
        ON a.summary_cust_id = b.summary_cust_id AND a.name < b.name
        JOIN items c ON c.summary_cust_id = b.summary_cust_id AND b.name < c.name GROUP BY 1), total
WHERE freq / n >= 0.1 ORDER BY freq DESC, items LIMIT 10""", *ITEMS, rounded="support")
# Sets of any size: each grows by later items, and keeps the customers that hold it.
STATEMENTS["association_rules"] = "WITH RECURSIVE " + ",".join(ITEMS) + """,
single AS (SELECT name, list(summary_cust_id) AS who FROM items GROUP BY 1),
sets(names, who) AS (
  SELECT [name], who FROM single, total WHERE len(who) / n >= 0.1
  UNION ALL
  SELECT list_append(s.names, b.name), list_intersect(s.who, b.who) FROM sets s JOIN single b ON b.name > s.names[-1], total
  WHERE len(list_intersect(s.who, b.who)) / n >= 0.1),
counted AS MATERIALIZED (SELECT names, len(who) AS f FROM sets),
rules AS (SELECT list_filter(names, lambda x: x <> c) AS l, c, f FROM (SELECT names, f, unnest(names) AS c FROM counted WHERE len(names) > 1))
SELECT array_to_string(l, '|') AS antecedent, c AS consequent, round(rules.f / a.f, 6) AS confidence,
       round((rules.f / a.f) / (b.f / n), 6) AS lift, round(rules.f / n, 6) AS support
FROM rules JOIN counted a ON a.names = l JOIN counted b ON b.names = [c], total WHERE rules.f / a.f >= 0.4"""

PAIRS = """
pairs AS (SELECT a.name AS a, b.name AS b, count(*) AS freq FROM items a JOIN items b USING (summary_cust_id)
          WHERE a.name <> b.name GROUP BY 1, 2)"""
put("vertical_itemsets", """
SELECT a || '|' || b AS items, freq, freq / n AS support FROM pairs, total WHERE a < b AND freq / n >= 0.02
UNION ALL
SELECT a.name || '|' || b.name || '|' || c.name, count(*), count(*) / any_value(n) FROM items a
  JOIN items b ON a.summary_cust_id = b.summary_cust_id AND a.name < b.name
  JOIN items c ON c.summary_cust_id = b.summary_cust_id AND b.name < c.name, total
  GROUP BY 1 HAVING count(*) / any_value(n) >= 0.02""", *ITEMS, PAIRS, rounded="support")
put("rules_by_confidence", """
SELECT p.a AS antecedent, p.b AS consequent, p.freq / l.f AS confidence, p.freq / l.f / (r.f / n) AS lift, p.freq / n AS support
FROM pairs p JOIN singles_of l ON l.name = p.a JOIN singles_of r ON r.name = p.b, total WHERE p.freq / l.f >= 0.2""",
    *ITEMS, PAIRS, "singles_of AS (SELECT name, count(*) AS f FROM items GROUP BY 1)", rounded="confidence lift support")

# --- series --------------------------------------------------------------------------------------------------

S = (t.TICKETS, t.PER_PERF, t.SERIES)
put("revenue_per_performance", """
SELECT strftime(perf_dt, '%Y-%m-%d %H:%M:%S') AS perf_dt, total_rev_singles, total_rev_subs FROM per_perf""",
    t.TICKETS, t.PER_PERF, rounded="total_rev_singles total_rev_subs")
put("monthly_revenue_series", "SELECT series_id, CAST(month AS VARCHAR) AS month, y FROM series", *S, rounded="y")
put("revenue_difference", """
SELECT series_id, CAST(month AS VARCHAR) AS month, d AS y
FROM (SELECT *, y - lag(y) OVER (PARTITION BY series_id ORDER BY month) AS d FROM series) WHERE d IS NOT NULL""",
    *S, rounded="y")
NAIVE = """
naive AS (SELECT *, lag(y, 12) OVER (PARTITION BY series_id ORDER BY month) AS fitted FROM series)"""
put("seasonal_naive", """
SELECT series_id, CAST(month AS VARCHAR) AS month, y, fitted, y - fitted AS residual FROM naive""", *S, NAIVE,
    rounded="y fitted residual")
put("seasonal_naive_accuracy", """
SELECT series_id, count(*) AS n, stddev_samp(e) AS residual_sd, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae
FROM (SELECT series_id, d - lag(d, 12) OVER (PARTITION BY series_id ORDER BY month) AS e
      FROM (SELECT *, y - lag(y) OVER (PARTITION BY series_id ORDER BY month) AS d FROM series) WHERE d IS NOT NULL)
WHERE e IS NOT NULL GROUP BY 1""", *S, rounded="residual_sd rmse mae", digits=4)
PAIRS = """
indexed AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month) AS i FROM series),
pairs AS (SELECT a.series_id, a.month, a.y, CAST(a.i - b.i AS BIGINT) AS lag, b.y AS lagged
          FROM indexed a JOIN indexed b ON a.series_id = b.series_id AND a.i - b.i BETWEEN 1 AND 4)"""
put("lag_pairs", 'SELECT series_id, CAST(month AS VARCHAR) AS month, y, "lag", lagged FROM pairs', *S, PAIRS,
    rounded="y lagged")
put("lag_correlations", 'SELECT series_id, "lag", corr(y, lagged) AS correlation FROM pairs GROUP BY 1, 2', *S, PAIRS,
    rounded="correlation")
put("residual_autocorrelation", f"""
SELECT *, {fits.CHI_SQUARE_1_TO_4} AS p_value
FROM (SELECT series_id, "lag", acf, n * (n + 2) * sum(acf * acf / (n - "lag")) OVER (PARTITION BY series_id ORDER BY "lag") AS q
FROM (SELECT a.series_id, CAST(a.i - b.i AS BIGINT) AS "lag", sum(a.e * b.e) / max(v.ss) AS acf, max(v.n) AS n
      FROM centred a JOIN centred b ON a.series_id = b.series_id AND a.i - b.i BETWEEN 1 AND 4
      JOIN (SELECT series_id, sum(e * e) AS ss, count(*) AS n FROM centred GROUP BY 1) v ON v.series_id = a.series_id
      GROUP BY 1, 2))""", *S, NAIVE, """
resid AS (SELECT series_id, month, y - fitted AS r, row_number() OVER (PARTITION BY series_id ORDER BY month) AS i
          FROM naive WHERE fitted IS NOT NULL),
centred AS (SELECT series_id, i, r - avg(r) OVER (PARTITION BY series_id) AS e FROM resid)""",
    rounded="acf q p_value", digits=4)
put("seasonal_view", "SELECT series_id, CAST(month(month) AS BIGINT) AS month_of_year, " + ", ".join(
    f'max(y) FILTER (year(month) = {y}) AS "{y}"' for y in range(1995, 2002)) + " FROM series GROUP BY 1, 2", *S,
    rounded=" ".join(f'"{y}"' for y in range(1995, 2002)))
DECOMPOSED = """
indexed AS (SELECT *, month(month) AS m, row_number() OVER (PARTITION BY series_id ORDER BY month) AS i,
                   count(*) OVER (PARTITION BY series_id) AS n FROM series),
trends AS (
  SELECT a.series_id, a.month, a.m, a.y,
         CASE WHEN a.i > 6 AND a.i <= a.n - 6
              THEN sum(b.y * CASE WHEN abs(a.i - b.i) = 6 THEN 0.5 ELSE 1 END) / 12 END AS trend
  FROM indexed a JOIN indexed b ON a.series_id = b.series_id AND abs(a.i - b.i) <= 6
  GROUP BY a.series_id, a.month, a.m, a.y, a.i, a.n),
effects AS (SELECT series_id, m, avg(y - trend) AS effect FROM trends GROUP BY 1, 2)"""
put("decomposition", """
SELECT series_id, CAST(month AS VARCHAR) AS month, y, trend, effect - centre AS seasonal,
       y - trend - (effect - centre) AS remainder
FROM trends JOIN effects USING (series_id, m) JOIN (SELECT series_id, avg(effect) AS centre FROM effects GROUP BY 1)
  USING (series_id)""", *S, DECOMPOSED,
    rounded="y trend seasonal remainder")
put("simple_smoothing", """
SELECT series_id, sum(y * CASE WHEN i = 1 THEN pow(0.7, n - 1) ELSE 0.3 * pow(0.7, n - i) END) AS level
FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month) AS i,
             count(*) OVER (PARTITION BY series_id) AS n FROM series) GROUP BY 1""", *S, rounded="level", digits=4)
AR = """
lagged AS (SELECT * FROM (SELECT *, lag(y) OVER w AS a, lag(y, 12) OVER w AS b FROM series
                          WINDOW w AS (PARTITION BY series_id ORDER BY month)) WHERE b IS NOT NULL),
moments AS (SELECT series_id, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS saa,
                   var_samp(b) AS sbb, covar_samp(a, b) AS sab, covar_samp(a, y) AS say, covar_samp(b, y) AS sby, var_samp(y) AS syy
            FROM lagged GROUP BY 1),
fit AS (SELECT series_id, n, my - p * ma - q * mb AS constant, p AS phi_1, q AS phi_12,
               sqrt((syy - p * say - q * sby) * (n - 1) / (n - 3)) AS residual_sd
        FROM (SELECT *, (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS p,
                     (sby * saa - say * sab) / (saa * sbb - sab * sab) AS q FROM moments))"""
put("seasonal_autoregression", "SELECT * FROM fit", *S, AR, rounded="constant phi_1 phi_12 residual_sd", digits=4)
STATEMENTS["autoregressive_forecast"] = "WITH RECURSIVE " + ",".join((*S, AR)) + """,
steps(series_id, month, y, h, psi) AS (
  SELECT series_id, month, y, 0, [CAST(1 AS DOUBLE)] FROM series WHERE month = (SELECT max(month) FROM series)
  UNION ALL
  SELECT s.series_id, CAST(s.month + INTERVAL 1 MONTH AS DATE), f.constant + f.phi_1 * s.y + f.phi_12 * o.y, s.h + 1,
         list_append(s.psi, f.phi_1 * s.psi[-1] + CASE WHEN s.h >= 11 THEN f.phi_12 * s.psi[s.h - 10] ELSE 0 END)
  FROM steps s JOIN fit f ON f.series_id = s.series_id
  JOIN series o ON o.series_id = s.series_id AND o.month = CAST(s.month - INTERVAL 11 MONTHS AS DATE)
  WHERE s.h < 12)
SELECT series_id, CAST(month AS VARCHAR) AS month, round(y, 4) AS forecast,
       round(y - 1.959964 * residual_sd * sqrt(list_sum(list_transform(psi[1:h], lambda w: w * w))), 4) AS low,
       round(y + 1.959964 * residual_sd * sqrt(list_sum(list_transform(psi[1:h], lambda w: w * w))), 4) AS high
FROM steps JOIN fit USING (series_id) WHERE h > 0"""

CHOICE = ",".join((*S, DECOMPOSED, *orders.choice()))
STATEMENTS["auto_order_choice"] = f"""WITH RECURSIVE {CHOICE}
SELECT series_id, orders, constant, round(strength, 4) AS seasonal_strength, round(aicc, 4) AS aicc,
       round(sqrt(variance) * spread, 4) AS residual_sd FROM best"""
STATEMENTS["auto_order_forecast"] = f"""WITH RECURSIVE {CHOICE},{",".join(orders.forecasts())}
SELECT a.series_id, CAST(CAST(last_month + to_months(CAST(a.h AS INTEGER)) AS DATE) AS VARCHAR) AS month, orders,
       round(a.y[-1], 4) AS forecast, round(a.y[-1] - half, 4) AS low, round(a.y[-1] + half, 4) AS high
FROM (SELECT *, 1.959964 * sqrt(variance) * spread * sqrt(list_sum(list_transform(py[15:], lambda x: x * x))) AS half
      FROM ahead JOIN best USING (series_id)) a
JOIN (SELECT series_id, max(month) AS last_month FROM series GROUP BY 1) USING (series_id) WHERE a.h > 0"""

FORMS = ",".join((*S, *smoothing.choice()))
STATEMENTS["smoothing_choice"] = f"""WITH RECURSIVE {FORMS}
SELECT series_id, form, round(a, 4) AS alpha, round(CASE WHEN trend > 0 THEN a * b END, 4) AS beta,
       round(CASE WHEN season > 0 THEN (1 - a) * g END, 4) AS gamma, round(CASE WHEN trend = 2 THEN phi END, 4) AS phi,
       round(aicc, 4) AS aicc, CAST(n AS BIGINT) AS n, round(se / n, 4) AS me, round(sqrt(sse / n), 4) AS rmse,
       round(sae / n, 4) AS mae, round(100 * sape / n, 4) AS mape FROM chosen"""
STATEMENTS["smoothing_forecast"] = f"""WITH RECURSIVE {FORMS},{",".join(smoothing.forecasts())}
SELECT series_id, CAST(CAST(last_month + to_months(CAST(h AS INTEGER)) AS DATE) AS VARCHAR) AS month, form,
       round(forecast, 4) AS forecast, round(forecast - half, 4) AS low, round(forecast + half, 4) AS high
FROM spreads JOIN (SELECT series_id, last_month FROM sm) USING (series_id)"""

for name, turns in (("local_decomposition", (2, 0)), ("robust_decomposition", (1, 15))):
    put(name, "SELECT series_id, CAST(month AS VARCHAR) AS month, y, trend, seasonal, remainder FROM parts", *S,
        *local.decomposition(*turns), rounded="y trend seasonal remainder")

# --- regressions ---------------------------------------------------------------------------------------------

VIEWERS = """
viewers AS (
  SELECT c_custkey AS viewer_id, CASE WHEN c_acctbal + 60 * (c_custkey % 50) > 6000 THEN 1 ELSE 0 END AS buy,
         CASE WHEN c_custkey % 5 < 2 THEN 1 ELSE 0 END AS "view", c_custkey % 2 = 1 AS training FROM customer),
rates AS (SELECT "view", avg(buy) AS p, count(*) AS n FROM viewers WHERE training GROUP BY 1)"""
put("viewer_probabilities", 'SELECT CAST("view" AS BIGINT) AS "view", n AS viewers, p AS probability FROM rates', VIEWERS,
    rounded="probability")
put("viewer_deviance", """
SELECT sum(ln(CASE WHEN buy = 1 THEN p ELSE 1 - p END)) AS log_likelihood,
       -2 * sum(ln(CASE WHEN buy = 1 THEN p ELSE 1 - p END)) AS deviance
FROM viewers JOIN rates USING ("view") WHERE training""", VIEWERS, rounded="log_likelihood deviance", digits=4)
put("viewer_tail_rates", """
SELECT CASE WHEN tile = 1 THEN 'lowest' ELSE 'highest' END AS part, count(*) AS n, avg(buy) AS rate
FROM (SELECT buy, ntile(5) OVER (ORDER BY p, viewer_id) AS tile FROM viewers JOIN rates USING ("view") WHERE NOT training)
WHERE tile IN (1, 5) GROUP BY 1""", VIEWERS, rounded="rate")
FULL_VIEWERS = """
activity AS (SELECT o_custkey, count(*) AS totvids, count(*) FILTER (o_orderpriority = '1-URGENT') AS elecvids FROM orders
             GROUP BY 1),
people AS (
  SELECT c_custkey AS viewer_id, CASE WHEN c_acctbal + 60 * (c_custkey % 50) > 6000 THEN 1 ELSE 0 END AS y,
         CASE WHEN c_custkey % 5 < 2 THEN 1 ELSE 0 END AS "view", coalesce(totvids, 0) AS totvids,
         coalesce(elecvids, 0) AS elecvids, c_nationkey % 3 AS browser, c_nationkey % 2 AS mobile, 18 + c_custkey % 50 AS age,
         CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS man, c_custkey % 2 = 1 AS training
  FROM customer LEFT JOIN activity ON c_custkey = o_custkey),
learn AS (SELECT * FROM people WHERE training)"""
VIEWER_PREDICTORS = ['"view"', "totvids", "elecvids", "(browser = 1)", "(browser = 2)", "mobile", "age", "man"]
LARGE = fits.logistic("learn", VIEWER_PREDICTORS, "large")
LIST = "[CAST(1 AS DOUBLE), " + ", ".join(f"CAST({x} AS DOUBLE)" for x in VIEWER_PREDICTORS) + "]"
CHANCES = f"""
chances AS (SELECT viewer_id, y, training, 1 / (1 + exp(-list_dot_product({LIST}, b))) AS p FROM people, large_beta)"""
LIKELIHOOD = "sum(ln(CASE WHEN y = 1 THEN p ELSE 1 - p END))"
put("viewer_holdout_deviance", f"""
SELECT {LIKELIHOOD} AS log_likelihood, -2 * {LIKELIHOOD} AS deviance FROM chances WHERE NOT training""",
    FULL_VIEWERS, *LARGE, CHANCES, rounded="log_likelihood deviance", digits=4)
put("viewer_likelihood_ratio", f"""
SELECT small AS deviance_small, large AS deviance_large, small - large AS chi_square, CAST(7 AS BIGINT) AS df,
       exp(-(small - large) / 2) * 0 + {{tail}} AS p_value
FROM (SELECT -2 * {LIKELIHOOD} AS large FROM chances WHERE training),
     (SELECT -2 * sum(ln(CASE WHEN y = 1 THEN q ELSE 1 - q END)) AS small
      FROM learn JOIN (SELECT "view", avg(y) AS q FROM learn GROUP BY 1) USING ("view"))""".replace("exp(-(small - large) / 2) * 0 + {tail}", fits.CHI_SQUARE_7),
    FULL_VIEWERS, *LARGE, CHANCES, rounded="deviance_small deviance_large chi_square p_value", digits=4)
put("viewer_model_tail_rates", """
SELECT CASE WHEN tile = 1 THEN 'lowest' ELSE 'highest' END AS part, count(*) AS n, avg(y) AS rate
FROM (SELECT y, ntile(5) OVER (ORDER BY p, viewer_id) AS tile FROM chances WHERE NOT training)
WHERE tile IN (1, 5) GROUP BY 1""", FULL_VIEWERS, *LARGE, CHANCES, rounded="rate")
put("goal_errors", """
SELECT sqrt(avg(pow(revenue - goal, 2))) AS rmse_goal, avg(abs((revenue - goal) / nullif(revenue, 0))) * 100 AS mape_goal
FROM (SELECT perf_dt, sum(paid_amt) AS revenue, count(*) * 25.0 AS goal FROM tickets GROUP BY 1)""", t.TICKETS,
    rounded="rmse_goal mape_goal", digits=4)
put("web_days_split", """
SELECT device, CAST(date AS VARCHAR) AS date, substr(md5(device || CAST(date AS VARCHAR)), 1, 2) < 'cd' AS is_training
FROM daily WHERE avg_session_duration IS NOT NULL AND avg_time_on_page IS NOT NULL AND percent_new_sessions IS NOT NULL""",
    t.HITS, t.sessions(), f"daily AS (SELECT device, date, {DAILY} FROM sess GROUP BY 1, 2)")

put("web_days_exact_split", """
SELECT device, CAST(date AS VARCHAR) AS date, row_number() OVER (
         PARTITION BY device ORDER BY substr(md5(device || CAST(date AS VARCHAR)), 1, 15))
       <= floor(0.8 * count(*) OVER (PARTITION BY device) + 0.5) AS is_training
FROM daily WHERE avg_session_duration IS NOT NULL AND avg_time_on_page IS NOT NULL AND percent_new_sessions IS NOT NULL""",
    t.HITS, t.sessions(), f"daily AS (SELECT device, date, {DAILY} FROM sess GROUP BY 1, 2)")

for name, degree, source in (("revenue_trend_cubic", 3, None), ("weekday_trend_degree_8", 8, "tix")):
    extra = S if source is None else (*N, """
per_day AS (SELECT CAST(date_trunc('month', perf_dt) AS DATE) AS month, day_of_week AS series_id, count(*) AS n
            FROM sold WHERE kind <> 'Comp' GROUP BY 1, 2),
tix AS (SELECT series_id, month, CAST(coalesce(n, 0) AS DOUBLE) AS y
        FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-11-01', INTERVAL 1 MONTH)) AS DATE) AS month)
        CROSS JOIN (VALUES ('Thursday'), ('Friday'), ('Saturday')) d(series_id) LEFT JOIN per_day USING (series_id, month))""")
    put(name, "SELECT * REPLACE (CAST(month AS VARCHAR) AS month) FROM curve", *extra,
        *fits.polynomial(source or "series", degree), rounded="y fitted low high")
STATEMENTS["exponential_smoothing"] = "WITH RECURSIVE " + ",".join((*S, fits.SMOOTHING)) + """
SELECT series_id, CAST(month AS VARCHAR) AS month, 'triple' AS method, round(forecast, 4) AS forecast,
       round(forecast - 1.959964 * residual_sd * spread, 4) AS low,
       round(forecast + 1.959964 * residual_sd * spread, 4) AS high, round(residual_sd, 4) AS residual_sd FROM forecasts"""

STATEMENTS["smoothing_accuracy"] = "WITH RECURSIVE " + ",".join((*S, fits.SMOOTHING)) + """
SELECT series_id, CAST(n - 12 AS BIGINT) AS n, round(se / (n - 12), 4) AS me, round(sqrt(sse / (n - 12)), 4) AS rmse,
       round(sae / (n - 12), 4) AS mae FROM best"""

FEATURES = """
same_year AS (
  SELECT perf_dt, max(fy) AS fy, sum(paid_amt) AS y, CAST(count(*) * 25 AS DOUBLE) AS goal,
         count(*) FILTER (price_type_group = 'Flex') AS flex_now, month(perf_dt) AS month,
         dayofyear(perf_dt) % 4 AS composer_tier, day(perf_dt) % 3 AS guest_artist_tier,
         CASE WHEN dayofyear(perf_dt) % 5 = 0 THEN 1 ELSE 0 END AS violin,
         CASE WHEN dayofyear(perf_dt) % 7 = 0 THEN 1 ELSE 0 END AS piano,
         CASE WHEN dayofyear(perf_dt) % 11 = 0 THEN 1 ELSE 0 END AS opera
  FROM tickets GROUP BY 1),
features AS (SELECT a.*, coalesce(b.flex_now, 0) AS flex_sold
             FROM same_year a LEFT JOIN same_year b ON b.perf_dt = a.perf_dt - INTERVAL 1 YEAR),
train AS (SELECT * FROM features WHERE fy < 2001)"""
PREDICTORS = ["flex_sold", "violin", "piano", "opera", *[f"(month = {m})" for m in range(2, 13)],
              *[f"(composer_tier = {k})" for k in (1, 2, 3)], "(guest_artist_tier = 1)", "(guest_artist_tier = 2)"]
FITTED = f"fitted AS (SELECT *, {fits.fitted(PREDICTORS)} AS p FROM train, rev_beta)"
MODEL = (t.TICKETS, FEATURES, *fits.least_squares("train", PREDICTORS, "rev"))
TERMS = ["flex_sold", "guest_violin", "guest_piano", "opera", *[f"month_{m}" for m in range(2, 13)],
         *[f"composer_tier_{k}" for k in (1, 2, 3)], "guest_artist_tier_1", "guest_artist_tier_2"]


def coefficient_rows(terms: list[str], name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{term}' AS term, b{k} AS estimate, e{k} AS std_error FROM {name}_beta"
                              for k, term in enumerate(["(Intercept)", *terms]))


FEW = ["flex_sold", "violin", "piano", "opera"]
put("aliased_regression", f"""
SELECT term, estimate, std_error, {fits.STUDENT_TAIL} AS p_value
FROM ({coefficient_rows(["flex_sold", "guest_violin", "guest_piano", "opera"], "few")}), (SELECT count(*) - 5 AS f FROM train)
UNION ALL SELECT x, NULL, NULL, NULL FROM (VALUES ('strings'), ('pairs')) a(x)""", t.TICKETS, FEATURES,
    *fits.least_squares("train", FEW, "few", errors=True), rounded="estimate std_error p_value", digits=4)
put("performance_regression", coefficient_rows(TERMS, "rev"), t.TICKETS, FEATURES,
    *fits.least_squares("train", PREDICTORS, "rev", errors=True), rounded="estimate std_error", digits=4)
put("roas_regression", coefficient_rows(["device_mobile", "device_tablet", "new_users", "ad_cost"], "roas"), t.HITS, t.sessions(),
    """
per_day AS (
  SELECT device, date, new_users, ad_cost, 100 * revenue / nullif(ad_cost, 0) AS y
  FROM (SELECT device, date, count(*) FILTER (is_new) AS new_users,
               coalesce(sum(value * 0.01) FILTER (event_type = 'click' AND ad_group IS NOT NULL), 0.0) AS ad_cost,
               coalesce(sum(value) FILTER (event_type = 'purchase'), 0.0) AS revenue FROM sess GROUP BY 1, 2)),
paid AS (SELECT * FROM per_day WHERE y IS NOT NULL)""",
    *fits.least_squares("paid", ["(device = 'mobile')", "(device = 'tablet')", "new_users", "ad_cost"], "roas", errors=True),
    rounded="estimate std_error", digits=4)
put("performance_regression_quality", f"""
SELECT r2, 1 - (1 - r2) * (n - 1) / (n - {len(PREDICTORS) + 1}) AS adjusted_r2, rmse, n
FROM (SELECT 1 - sum(pow(y - p, 2)) / sum(pow(y - m, 2)) AS r2, sqrt(avg(pow(y - p, 2))) AS rmse, count(*) AS n
      FROM fitted, (SELECT avg(y) AS m FROM train))""", *MODEL, FITTED, rounded="r2 adjusted_r2 rmse", digits=4)
put("forecast_vs_goal", """
SELECT sqrt(avg(pow(y - p, 2))) AS rmse_prediction, sqrt(avg(pow(y - goal, 2))) AS rmse_goal,
       avg(abs((y - p) / nullif(y, 0))) * 100 AS mape_prediction, avg(abs((y - goal) / nullif(y, 0))) * 100 AS mape_goal
FROM fitted""", *MODEL, FITTED, rounded="rmse_prediction rmse_goal mape_prediction mape_goal", digits=4)
put("projection_difference", f"""
SELECT strftime(perf_dt, '%Y-%m-%d %H:%M:%S') AS perf_dt, goal AS projected, {fits.fitted(PREDICTORS)} AS prediction,
       {fits.fitted(PREDICTORS)} - goal AS difference FROM features, rev_beta WHERE fy = 2001""", *MODEL,
    rounded="projected prediction difference", digits=4)
VALUE_PREDICTORS = ["avg_session_duration", "unique_page_views", "impressions", "avg_time_on_page", "ad_cost",
                    "ln(new_users + 1)"]
put("web_value_scored", f"""
SELECT device, CAST(date AS VARCHAR) AS date, total_value, {fits.fitted(VALUE_PREDICTORS)} AS prediction
FROM split, val_beta WHERE NOT training""", t.HITS, t.sessions(), f"""
daily AS (SELECT device, date, {DAILY} FROM sess GROUP BY 1, 2),
split AS (SELECT *, total_value AS y, substr(md5(device || CAST(date AS VARCHAR)), 1, 2) < 'cd' AS training FROM daily
          WHERE avg_session_duration IS NOT NULL AND avg_time_on_page IS NOT NULL AND percent_new_sessions IS NOT NULL),
learn AS (SELECT * FROM split WHERE training)""", *fits.least_squares("learn", VALUE_PREDICTORS, "val"),
    rounded="total_value prediction", digits=4)
LOG_PREDICTORS = ["ln(digital_ads)", "print_total", "email_services", "direct_mail", "radio_and_tv", "performances",
                  "promotions"]
LOG_TERMS = ["(Intercept)", "log_digital_ads", *LOG_PREDICTORS[1:]]
put("marketing_log_regression", " UNION ALL ".join(
    f"SELECT '{term}' AS term, b{k} AS estimate FROM mix_beta" for k, term in enumerate(LOG_TERMS)), *MIXED, BAND, """
logged AS (SELECT *, ln(sessions) AS y FROM band WHERE sessions > 0 AND digital_ads > 0)""",
    *fits.least_squares("logged", LOG_PREDICTORS, "mix"), rounded="estimate", digits=6)

SPEND = ["digital_ads", "print_media", "print_production", "email_services", "direct_mail", "radio_and_tv", "performances",
         "promotions"]
put("marketing_revenue_regression", coefficient_rows(SPEND, "rev"), t.TICKETS, t.SINGLES, t.SINGLE_MONTHS, t.PERF_MONTHS,
    t.EXPENSES, t.EXPENSE_MONTHS, """
spent AS (SELECT *, ln(revenue) AS y FROM single_months JOIN expense_months USING (date) JOIN perf_months USING (date)
          WHERE revenue > 0)""", *fits.least_squares("spent", SPEND, "rev", errors=True), rounded="estimate std_error", digits=6)

# --- columns and single operators ----------------------------------------------------------------------------

put("ticket_columns", """
SELECT summary_cust_id, strftime(perf_dt, '%Y-%m-%d %H:%M:%S') AS perf_dt, paid_amt, fy,
       greatest(1997, least(2000, fy)) AS fy_clamped, substr(season_desc, 1, 8) AS season,
       'fy' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') AS fy_label, dayname(perf_dt) AS day_of_week,
       substr(zone_desc, 1, 7) AS price_zone,
       CASE WHEN price_type_group IN ('Single ', 'Discount') THEN 'Single'
            WHEN price_type_group IN ('Subscription', 'Flex', 'Comp') THEN price_type_group ELSE 'Unsold' END AS price_type,
       CASE price_type_group WHEN 'Flex' THEN 'Subscription' WHEN 'Discount' THEN 'Single'
            ELSE trim(price_type_group) END AS report_type,
       CASE WHEN price_type_group IN ('Subscription', 'Flex') THEN 'Subscription' ELSE 'Single' END AS sub_or_single,
       CASE WHEN price_type_group IN ('Single ', 'Discount') THEN 'Single' ELSE 'Subscription' END AS single_or_sub,
       CAST(CASE WHEN attended = 'Attended' THEN 1 ELSE 0 END AS BIGINT) AS attended,
       section || '   ' || "row" || ' - ' || seat AS seat_label
FROM tickets""", t.TICKETS, rounded="paid_amt")
put("customer_age_columns", f"""
SELECT summary_cust_id AS customer_no, CAST(key_value AS BIGINT) AS key_value, CAST(coalesce(age, -1) AS BIGINT) AS age,
       CASE WHEN key_value = 0 THEN NULL WHEN key_value <= 1954 THEN 'group_65_and_older'
            WHEN key_value <= 1974 THEN 'group_45_to_64' ELSE 'under_44' END AS age_group, {AGE} AS age_decade
FROM (SELECT *, CASE WHEN key_value > 0 THEN 2001 - key_value END AS age FROM births)""", t.BIRTHS)
put("parsed_dates", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_time,
       CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS order_month,
       CAST(year(o_orderdate) AS BIGINT) AS order_year, CAST(CAST(o_orderdate AS DATE) + 1 AS VARCHAR) AS next_day
FROM orders""")
put("order_sample", """
SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 10""")
put("gift_summary", " UNION ALL ".join(f"""
SELECT '{x}' AS "column", min({x})::DOUBLE AS min_value, quantile_cont({x}::DOUBLE, 0.25) AS first_quartile,
       quantile_cont({x}::DOUBLE, 0.5) AS median, avg({x}) AS mean, quantile_cont({x}::DOUBLE, 0.75) AS third_quartile,
       max({x})::DOUBLE AS max_value FROM donations""" for x in ("gift_plus_pledge", "cont_fy", "summary_cust_id")),
    t.DONATIONS, rounded="min_value first_quartile median mean third_quartile max_value", digits=4)
put("price_density", """
SELECT price_type_group, bin, n, n / (sum(n) OVER (PARTITION BY price_type_group) * 5.0) AS density
FROM (SELECT price_type_group, CAST(floor(paid_amt / 5.0) AS BIGINT) + 1 AS bin, count(*) AS n FROM tickets
      WHERE paid_amt > 0 GROUP BY 1, 2)""", t.TICKETS, rounded="density")
put("price_kernel_density", """
SELECT price_type_group, n, h AS bandwidth, lo + j * step AS x,
       sum(w * exp(-0.5 * pow((j - cell) * step / h, 2))) / (n * h * sqrt(2 * pi())) AS density
FROM weights, (SELECT unnest(range(128)) AS j) GROUP BY price_type_group, n, h, lo, step, j""", t.TICKETS, """
paid AS (SELECT price_type_group, paid_amt AS v FROM tickets WHERE paid_amt > 0),
widths AS (
  SELECT price_type_group, count(*) AS n, min(v) AS least, max(v) AS most,
         0.9 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34) * pow(count(*), -0.2) AS h
  FROM paid GROUP BY 1),
steps AS (SELECT *, least - 3 * h AS lo, (most - least + 6 * h) / 127 AS step FROM widths),
near AS (SELECT s.*, (v - lo) / step AS spot FROM paid JOIN steps s USING (price_type_group)),
weights AS MATERIALIZED (
  SELECT price_type_group, n, h, lo, step, cell, sum(w) AS w FROM (
    SELECT *, floor(spot) AS cell, 1 - (spot - floor(spot)) AS w FROM near
    UNION ALL SELECT *, floor(spot) + 1, spot - floor(spot) FROM near) GROUP BY ALL)""", rounded="bandwidth x density", digits=8)
put("zone_shares_by_fy", """
SELECT fy, price_zone, paid, attended, paid / total AS share
FROM (SELECT fy, substr(zone_desc, 1, 7) AS price_zone, sum(paid_amt) AS paid,
             count(*) FILTER (attended = 'Attended') AS attended FROM tickets WHERE paid_amt > 0 GROUP BY 1, 2)
JOIN (SELECT fy, sum(paid_amt) AS total FROM tickets WHERE paid_amt > 0 GROUP BY 1) USING (fy)""", t.TICKETS,
    rounded="paid share")

# --- files ---------------------------------------------------------------------------------------------------

put("season_store", f"""
SELECT season_desc, price_type_group, count(*) AS seats, sum(paid_amt) AS paid FROM tickets
WHERE season_desc IN {t.in_list(POPS + CLASSICS)} GROUP BY 1, 2""", t.TICKETS, rounded="paid")
put("extract_scan", """
SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_time FROM orders""",
    rounded="o_totalprice")
put("report_sheets", """
SELECT 'types' AS sheet, price_type_group AS item, CAST(n AS DOUBLE) AS value
FROM (SELECT price_type_group, count(*) AS n FROM tickets GROUP BY 1), (VALUES (1), (2)) twice(i)
UNION ALL SELECT 'revenue', day_of_week, sum(paid_amt) FROM sold GROUP BY 2""", *N, rounded="value")
put("birth_year_extract", "SELECT summary_cust_id AS customer_no, CAST(key_value AS BIGINT) AS key_value FROM births", t.BIRTHS)
put("donation_csv", """
SELECT cont_fy, count(*) AS gifts, sum(gift_plus_pledge) AS given FROM donations GROUP BY 1""", t.DONATIONS,
    rounded="given")
put("grouped_report_sheets", "SELECT day_of_week, sum(paid_amt) AS rev FROM sold GROUP BY 1", *N, rounded="rev")
put("performance_names", "SELECT strftime(perf_dt, '%Y-%m-%d %H:%M:%S') AS perf_dt, name FROM performances", t.PERFORMANCES)
