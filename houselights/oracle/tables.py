"""Common table expressions: the logical tables in plain SQL, written independently of the Spark views."""

TICKETS = """
tickets AS (
  SELECT CASE WHEN taken THEN o_custkey WHEN l_suppkey % 2 = 1 THEN 0 END AS summary_cust_id,
         'PS ' || lpad(CAST((fy - 1) % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0')
           || CASE o_orderstatus WHEN 'O' THEN ' Classics' WHEN 'F' THEN ' Pops' ELSE ' Summer' END AS season_desc,
         CASE WHEN NOT taken THEN 'Unsold' WHEN l_linenumber = 6 THEN 'Comp' WHEN l_linenumber = 5 THEN 'Discount'
              WHEN l_linenumber <= 3 AND o_custkey % 2 = 1 AND fy >= 1996 + o_custkey % 7
                THEN CASE WHEN l_linenumber = 3 THEN 'Flex' ELSE 'Subscription' END
              ELSE 'Single ' END AS price_type_group,
         CASE WHEN l_linenumber >= 6 OR NOT taken THEN 0.0
              ELSE floor(l_extendedprice * (1 - l_discount) / 10) / 100.0 END AS paid_amt,
         'Price ' || CASE WHEN l_suppkey % 6 = 0 THEN 'B' ELSE CAST(l_suppkey % 6 AS VARCHAR) END
           || ' - ' || l_linestatus AS zone_desc,
         l_shipdate + INTERVAL 20 HOURS AS perf_dt,
         o_orderdate AS order_dt,
         'S' || CAST(l_partkey % 12 AS VARCHAR) AS section,
         CAST(l_partkey % 40 AS VARCHAR) AS "row",
         CAST(l_linenumber AS VARCHAR) AS seat,
         CASE WHEN NOT taken THEN NULL WHEN l_returnflag = 'R' THEN 'Not Attended' ELSE 'Attended' END AS attended,
         fy
  FROM (SELECT *, l_linenumber <> 7 AND fy >= 1995 + o_custkey % 7 AND (o_custkey + fy) % 3 <> 0 AS taken
        FROM (SELECT *, CAST(year(l_shipdate + INTERVAL 6 MONTHS) AS BIGINT) AS fy
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey)))"""

NORMAL = """
normal AS (
  SELECT perf_dt, fy, paid_amt, summary_cust_id, substr(zone_desc, 1, 7) AS price_zone, dayname(perf_dt) AS day_of_week,
         CASE WHEN price_type_group IN ('Single ', 'Discount') THEN 'Single'
              WHEN price_type_group IN ('Subscription', 'Flex', 'Comp') THEN price_type_group
              ELSE 'Unsold' END AS kind,
         CASE WHEN attended = 'Attended' THEN 1 ELSE 0 END AS came
  FROM tickets WHERE dayname(perf_dt) <> 'Tuesday'),
sold AS (SELECT * FROM normal WHERE kind <> 'Unsold')"""

DONATIONS = """
donations AS (
  SELECT o_custkey AS summary_cust_id,
         floor(o_totalprice * 100 / pow(10.0, o_custkey % 4)) / 100.0 AS gift_plus_pledge,
         CAST(year(o_orderdate + INTERVAL 6 MONTHS) AS BIGINT) AS cont_fy
  FROM orders),
giving AS (SELECT summary_cust_id, sum(gift_plus_pledge) AS total_gift FROM donations GROUP BY 1)"""

BANDS = """
bands AS (
  SELECT summary_cust_id,
         CASE WHEN total_gift >= 500000 THEN 'A' WHEN total_gift >= 250000 THEN 'B' WHEN total_gift >= 100000 THEN 'C'
              WHEN total_gift >= 50000 THEN 'D' WHEN total_gift >= 10000 THEN 'E' WHEN total_gift >= 1000 THEN 'F'
              WHEN total_gift >= 10 THEN 'G' ELSE 'H' END AS donor_group
  FROM giving),
sold_banded AS (SELECT sold.*, coalesce(donor_group, 'H') AS donor_group FROM sold LEFT JOIN bands USING (summary_cust_id))"""

PRICES = """
prices AS (
  SELECT zone AS price_zone, d AS day_of_week, p + CASE WHEN d = 'Saturday' THEN 10.0 ELSE 0.0 END AS standard_price
  FROM (VALUES ('Price 1', 121.0), ('Price 2', 91.0), ('Price 3', 71.0), ('Price 4', 41.0), ('Price 5', 25.0),
               ('Price B', 199.0)) z(zone, p), (VALUES ('Thursday'), ('Friday'), ('Saturday')) w(d))"""

BIRTHS = """
births AS (
  SELECT c_custkey AS summary_cust_id,
         CASE WHEN c_nationkey = 0 THEN 0 ELSE 1915 + c_custkey % 90 END AS key_value
  FROM customer)"""

PERFORMANCES = """
performances AS (
  SELECT DISTINCT l_shipdate + INTERVAL 20 HOURS AS perf_dt,
         'Program ' || lpad(CAST(dayofyear(l_shipdate) % 15 AS VARCHAR), 2, '0') AS name
  FROM lineitem)"""

HITS = """
hits AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(ts AS DATE) AS date, event_type AS channel,
         '/page/' || CAST(k AS VARCHAR) AS page,
         CASE WHEN k % 2 = 0 THEN 'Group ' || lpad(CAST(k AS VARCHAR), 2, '0') END AS ad_group,
         CASE user_id % 6 WHEN 0 THEN '18-24' WHEN 1 THEN '25-34' WHEN 2 THEN '35-44' WHEN 3 THEN '45-54'
              WHEN 4 THEN '55-64' ELSE '65+' END AS age_bracket,
         CASE user_id % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device,
         CAST(DATE '1996-07-01' + to_months(CAST(2 * date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))
              + CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END AS INTEGER)) AS DATE) AS report_date
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events))"""


def sessions(source: str = "hits") -> str:
    return f"""
gaps AS (
  SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS since, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS until
  FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
marked AS (
  SELECT *, since IS NULL OR since >= 43200000000 AS opens, until IS NULL OR until >= 43200000000 AS closes,
         since IS NULL AS is_new, CASE WHEN until < 43200000000 THEN until / 1000000.0 END AS stay
  FROM gaps),
numbered AS (
  SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sno
  FROM marked),
sess AS (
  SELECT *, first_value(channel) OVER v AS first_channel, first_value(date) OVER v AS first_date
  FROM numbered WINDOW v AS (PARTITION BY user_id, sno ORDER BY ts, event_id))"""


EXPENSES = """
expenses AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, floor(l_extendedprice * l_tax) / 100.0 + 0.0 AS exp,
         CASE l_suppkey % 7 WHEN 0 THEN 'DigitalAds' WHEN 1 THEN 'DirectMail' WHEN 2 THEN 'EmailServices'
              WHEN 3 THEN 'PrintMedia' WHEN 4 THEN 'PrintProduction' WHEN 5 THEN 'Promotions' ELSE 'RadioAndTV' END
           AS purpose
  FROM lineitem)"""

SINGLES = """
holders AS (SELECT DISTINCT summary_cust_id FROM tickets WHERE price_type_group IN ('Subscription', 'Flex')),
singles AS (
  SELECT * FROM tickets
  WHERE price_type_group IN ('Single ', 'Discount') AND paid_amt > 0 AND summary_cust_id > 0
    AND summary_cust_id NOT IN (SELECT summary_cust_id FROM holders WHERE summary_cust_id IS NOT NULL))"""

SINGLE_MONTHS = """
single_months AS (
  SELECT date, revenue FROM (
    SELECT date, revenue, row_number() OVER (ORDER BY date) AS rn FROM (
      SELECT CAST(date_trunc('month', order_dt) AS DATE) AS date, sum(paid_amt) AS revenue FROM singles GROUP BY 1))
  WHERE rn > 3)"""

PERF_MONTHS = """
perf_months AS (
  SELECT CAST(date_trunc('month', perf_dt) AS DATE) AS date, count(DISTINCT perf_dt) AS performances
  FROM tickets GROUP BY 1)"""

EXPENSE_MONTHS = """
expense_months AS (
  SELECT date,
         coalesce(sum(exp) FILTER (purpose = 'DigitalAds'), 0.0) AS digital_ads,
         coalesce(sum(exp) FILTER (purpose = 'DirectMail'), 0.0) AS direct_mail,
         coalesce(sum(exp) FILTER (purpose = 'EmailServices'), 0.0) AS email_services,
         coalesce(sum(exp) FILTER (purpose = 'PrintMedia'), 0.0) AS print_media,
         coalesce(sum(exp) FILTER (purpose = 'PrintProduction'), 0.0) AS print_production,
         coalesce(sum(exp) FILTER (purpose = 'Promotions'), 0.0) AS promotions,
         coalesce(sum(exp) FILTER (purpose = 'RadioAndTV'), 0.0) AS radio_and_tv
  FROM expenses GROUP BY 1)"""

WEB_MONTHS = """
web_months AS (
  SELECT CAST(date_trunc('month', report_date) AS DATE) AS date, count(*) FILTER (opens) AS sessions,
         count(*) FILTER (event_type = 'purchase') AS transactions,
         coalesce(sum(value) FILTER (event_type = 'purchase'), 0.0) AS transaction_revenue
  FROM sess GROUP BY 1)"""

MIX = """
mix AS (
  SELECT *, print_media + print_production AS print_total, revenue / performances AS rev_per_performance
  FROM single_months JOIN expense_months USING (date) JOIN perf_months USING (date) JOIN web_months USING (date))"""

PER_PERF = """
per_perf AS (
  SELECT perf_dt, CASE WHEN s.rev > 1500 THEN 1500.0 ELSE s.rev END AS total_rev_singles, b.rev AS total_rev_subs
  FROM (SELECT perf_dt, sum(paid_amt) AS rev FROM tickets WHERE paid_amt > 0 AND perf_dt < TIMESTAMP '2001-06-30'
          AND price_type_group IN ('Single ', 'Discount') GROUP BY 1) s
  JOIN (SELECT perf_dt, sum(paid_amt) AS rev FROM tickets WHERE paid_amt > 0 AND perf_dt < TIMESTAMP '2001-06-30'
          AND price_type_group IN ('Subscription', 'Flex') GROUP BY 1) b USING (perf_dt))"""

SERIES = """
per_month AS (
  SELECT CAST(date_trunc('month', perf_dt) AS DATE) AS month, avg(total_rev_singles) AS singles,
         avg(total_rev_subs) AS subs FROM per_perf GROUP BY 1),
reach AS (SELECT least(min(month), DATE '1996-07-01') AS lo, greatest(max(month), DATE '2001-06-01') AS hi FROM per_month),
spine AS (SELECT CAST(m AS DATE) AS month FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS m FROM reach)),
series AS (
  SELECT k.series_id, spine.month,
         coalesce(CASE k.series_id WHEN 'singles' THEN singles WHEN 'subs' THEN subs ELSE singles + subs END, 0.0) AS y
  FROM spine CROSS JOIN (VALUES ('singles'), ('subs'), ('combined')) k(series_id) LEFT JOIN per_month USING (month))"""


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def customer_values(seasons=None, first_fy=None) -> str:
    """Capped, counted tickets and one row per customer with frequency and spending."""
    where = f"WHERE season_desc IN {in_list(seasons)}" if seasons else f"WHERE fy >= {first_fy}" if first_fy else ""
    return f"""
upto AS (SELECT * FROM tickets WHERE summary_cust_id > 0 AND fy <= 2001),
capped AS (SELECT summary_cust_id FROM upto GROUP BY 1 HAVING count(*) <= 40),
good AS (SELECT * FROM upto WHERE summary_cust_id IN (SELECT summary_cust_id FROM capped) AND paid_amt > 5),
valued AS (
  SELECT summary_cust_id, count(*) AS freq, sum(paid_amt) / count(*) AS avg_paid_amt, sum(paid_amt) AS tot_paid_amt
  FROM good {where} GROUP BY 1)"""


def segmented(source: str = "valued") -> str:
    return f"""
limits AS (
  SELECT sum(tot_paid_amt) / sum(freq) AS pm, sum(tot_paid_amt) / sum(freq) + stddev_samp(avg_paid_amt) AS ph,
         avg(freq) AS fm, avg(freq) + stddev_samp(freq) AS fh,
         CASE WHEN avg(freq) - stddev_samp(freq) <= 0 THEN 2.1 ELSE avg(freq) - stddev_samp(freq) END AS fl
  FROM {source}),
segments AS (
  SELECT {source}.*,
         CASE WHEN avg_paid_amt > pm AND freq > fh THEN 'Aficionado'
              WHEN avg_paid_amt < pm AND freq > fm THEN 'Committed low-budget'
              WHEN avg_paid_amt < ph AND freq < fm AND freq > fl THEN 'Evolving concert-goer'
              WHEN avg_paid_amt > pm AND freq < fl THEN 'High-value prospect'
              WHEN avg_paid_amt < pm AND freq < fl THEN 'One-timer'
              ELSE 'High-value regular' END AS segment
  FROM {source}, limits)"""


KEY_SETS = """
renew_keys AS (SELECT DISTINCT summary_cust_id FROM good WHERE fy IN (2000, 2001)),
return_keys AS (SELECT DISTINCT summary_cust_id FROM good WHERE fy IN (1998, 1999)),
sub_keys AS (SELECT DISTINCT summary_cust_id FROM good WHERE fy = 2001 AND price_type_group IN ('Subscription', 'Flex'))"""

# Needs `attendees` (concert_date, summary_cust_id), good, return_keys, sub_keys, giving and segments.
AUDIENCE = """
first_now AS (SELECT summary_cust_id, min(perf_dt) AS first_dt FROM good WHERE fy = 2001 GROUP BY 1),
prior AS (SELECT DISTINCT summary_cust_id FROM good WHERE fy = 2000),
flagged AS (
  SELECT a.concert_date, a.summary_cust_id,
         CASE WHEN p.summary_cust_id IS NOT NULL OR f.first_dt < CAST(a.concert_date AS TIMESTAMP) THEN 1 ELSE 0 END AS renew,
         CASE WHEN r.summary_cust_id IS NOT NULL THEN 1 ELSE 0 END AS "return",
         CASE WHEN s.summary_cust_id IS NOT NULL THEN 1 ELSE 0 END AS subscriber,
         coalesce(g.total_gift, 0.0) AS donor_5yr_history, coalesce(x.segment, '0') AS segment
  FROM attendees a LEFT JOIN prior p USING (summary_cust_id) LEFT JOIN first_now f USING (summary_cust_id)
  LEFT JOIN return_keys r USING (summary_cust_id) LEFT JOIN sub_keys s USING (summary_cust_id)
  LEFT JOIN giving g USING (summary_cust_id) LEFT JOIN segments x USING (summary_cust_id)),
audience AS (
  SELECT *, CASE WHEN renew = 1 THEN 'renew' WHEN "return" = 1 THEN 'return' ELSE 'new' END AS classification,
         CASE WHEN donor_5yr_history < 1000 THEN 'Group A' WHEN donor_5yr_history < 10000 THEN 'Group B'
              WHEN donor_5yr_history < 100000 THEN 'Group C' ELSE 'Group D' END AS donor_group
  FROM flagged)"""


def summary(source: str) -> str:
    """The 17 measures per performance and zone, then the total row from the zone rows' raw sums."""
    return f"""
zoned AS (
  SELECT perf_dt, substr(zone_desc, 1, 7) AS zone, paid_amt,
         CASE price_type_group WHEN 'Flex' THEN 'Subscription' WHEN 'Discount' THEN 'Single'
              ELSE trim(price_type_group) END AS kind, coalesce(attended = 'Attended', false) AS here
  FROM {source}),
raw_zones AS (
  SELECT perf_dt, zone, count(*) AS seats, count(*) FILTER (kind = 'Subscription') AS sub_sold,
         coalesce(sum(paid_amt) FILTER (kind = 'Subscription'), 0.0) AS sub_rev,
         count(*) FILTER (kind = 'Single') AS sgl_sold,
         coalesce(sum(paid_amt) FILTER (kind = 'Single'), 0.0) AS sgl_rev,
         count(*) FILTER (kind = 'Comp') AS tot_comp, count(*) FILTER (here) AS att,
         count(*) FILTER (here AND kind = 'Comp') AS ca, count(*) FILTER (here AND kind = 'Subscription') AS sa,
         count(*) FILTER (here AND kind = 'Single') AS ga
  FROM zoned GROUP BY 1, 2),
raw_all AS (
  SELECT * FROM raw_zones
  UNION ALL
  SELECT perf_dt, 'Total', sum(seats), sum(sub_sold), sum(sub_rev), sum(sgl_sold), sum(sgl_rev), sum(tot_comp),
         sum(att), sum(ca), sum(sa), sum(ga) FROM raw_zones GROUP BY 1),
summary AS (
  SELECT strftime(perf_dt, '%Y-%m-%d %H:%M:%S') AS perf_dt, zone, CAST(seats AS BIGINT) AS seats,
         CAST(sub_sold AS BIGINT) AS sub_sold, sub_rev / nullif(sub_sold, 0) AS sub_avg, sub_rev,
         CAST(sgl_sold AS BIGINT) AS sgl_sold, sgl_rev / nullif(sgl_sold, 0) AS sgl_avg, sgl_rev,
         CAST(sub_sold + sgl_sold AS BIGINT) AS tot_sold, (sub_sold + sgl_sold) / seats AS prcnt_sold,
         sub_rev + sgl_rev AS tot_rev, CAST(tot_comp AS BIGINT) AS tot_comp, tot_comp / seats AS prcnt_comp,
         CAST(att AS BIGINT) AS att, ca / nullif(tot_comp, 0) AS comp_att, sa / nullif(sub_sold, 0) AS sub_att,
         ga / nullif(sgl_sold, 0) AS sgl_att, att / nullif(sub_sold + sgl_sold + tot_comp, 0) AS tot_att
  FROM (SELECT * REPLACE (round(sub_rev, 2) AS sub_rev, round(sgl_rev, 2) AS sgl_rev) FROM raw_all))"""
