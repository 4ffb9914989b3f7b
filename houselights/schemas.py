"""Declared schemas of the extracts. Dates arrive as text and are parsed on load."""

from __future__ import annotations

TICKETS = ("summary_cust_id BIGINT, summary_cust_name STRING, season_desc STRING, price_type_group STRING, "
           "paid_amt DOUBLE, zone_desc STRING, perf_dt STRING, order_dt STRING, section STRING, row STRING, "
           "seat STRING, attended STRING")
DONATIONS = "summary_cust_id BIGINT, gift_plus_pledge DOUBLE, cont_fy INT, campaign STRING, fund_desc STRING"
BIRTH_YEARS = "customer_no BIGINT, key_value INT"
CUSTOMERS = "customer_no BIGINT, display_name STRING"
PERFORMANCES = "perf_dt STRING, name STRING"
EXPENSES = "date STRING, exp DOUBLE, purpose STRING"
PROMOTIONS = "mt_desc STRING, response INT"

# Text forms of timestamps in the extracts; one season came without seconds.
TIMESTAMP_FORMS = ("M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm")
ISO_TIMESTAMP_FORMS = ("yyyy-MM-dd HH:mm:ss",)
