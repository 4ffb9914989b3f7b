from pyspark.sql import functions as F

from houselights.functions import columns as c


def values(df, column):
    return [row[0] for row in df.select(column).collect()]


def test_fiscal_year_turns_at_july_first(table):
    df = table([("2016-06-30 23:59:00",), ("2016-07-01 00:00:00",), ("2016-12-31 20:00:00",), (None,)], "t string", ["t"])
    t = F.col("t")
    assert values(df, c.fiscal_year(t)) == [2016, 2017, 2017, None]
    assert values(df, c.fiscal_year(t, 2017, 2019))[:3] == [2017, 2017, 2017]
    assert values(df, c.season_label(c.fiscal_year(t)))[:2] == ["PS 15-16", "PS 16-17"]
    assert values(df, c.short_fiscal_label(c.fiscal_year(t)))[1] == "fy17"


def test_season_label_pads_and_wraps(table):
    df = table([(2000,), (2001,), (2009,)], "fy int")
    assert values(df, c.season_label(F.col("fy"))) == ["PS 99-00", "PS 00-01", "PS 08-09"]


def test_price_types(table):
    df = table([("Single ",), ("Single",), ("Discount",), ("Subscription",), ("Flex",), ("Comp",), ("Hold",), (None,)],
               "raw string")
    raw = F.col("raw")
    assert values(df, c.price_type(raw)) == ["Single", "Unsold", "Single", "Subscription", "Flex", "Comp", "Unsold", None]
    assert values(df, c.report_price_type(raw)) == ["Single", "Single", "Single", "Subscription", "Subscription", "Comp",
                                                    "Hold", None]
    assert values(df, c.subscription_or_single(raw))[3:7] == ["Subscription", "Subscription", "Single", "Single"]
    assert values(df, c.single_or_subscription(raw))[:4] == ["Single", "Subscription", "Single", "Subscription"]


def test_giving_bands_at_their_bounds(table):
    bounds = [10, 1000, 10000, 50000, 100000, 250000, 500000]
    df = table([(b + e,) for b in bounds for e in (-0.01, 0.0, 0.01)] + [(None,)], "g double")
    g = F.col("g")
    assert "".join(values(df, c.giving_band_8(g))) == "HGGGFFFEEEDDDCCCBBBAAH"
    below = values(df, c.giving_band_4(g))
    up_to = values(df, c.giving_band_4(g, inclusive=True))
    assert below[3:9] == ["A", "B", "B", "B", "C", "C"] and up_to[3:9] == ["A", "A", "B", "B", "B", "C"]
    assert below[12:15] == ["C", "D", "D"] and up_to[12:15] == ["C", "C", "D"]
    assert below[-1] is None


def test_birth_years_and_ages(table):
    df = table([(0,), (1954,), (1955,), (1974,), (1975,)], "y int")
    assert values(df, c.age_group(F.col("y"))) == [None, "group_65_and_older", "group_45_to_64", "group_45_to_64",
                                                   "under_44"]
    assert values(df, c.age(F.col("y"), 2019)) == [None, 65, 64, 45, 44]
    ages = table([(a,) for a in (19, 20, 29, 30, 39, 40, 49, 50, 59, 60, 69, 70, 79, 80, 89, 90, 99, 100)], "a int")
    assert values(ages, c.age_decade(F.col("a"))) == [
        "less20", "twenties", "twenties", "thirties", "thirties", "fourties", "fourties", "fifties", "fifties", "sixties",
        "sixties", "seventies", "seventies", "eighties", "eighties", "nineties", "nineties", "hundreds"]


def test_segments_are_strict_at_thresholds(table):
    mid, high, fmid, fhigh, flow = 50.0, 70.0, 4.0, 8.0, 2.1
    cases = [(60, 9, c.AFICIONADO), (60, 8, c.REGULAR), (50, 9, c.REGULAR), (49, 5, c.LOW_BUDGET), (49, 4, c.REGULAR),
             (69, 3, c.EVOLVING), (70, 3, c.REGULAR), (60, 2, c.PROSPECT), (40, 2, c.ONE_TIMER), (50, 2, c.REGULAR)]
    df = table([(float(p), f) for p, f, _ in cases], "p double, f bigint")
    got = values(df, c.segment(F.col("p"), F.col("f"), *[F.lit(v) for v in (mid, high, fmid, fhigh, flow)]))
    assert got == [label for *_, label in cases]


def test_retention_scores(table):
    df = table([("A", "A"), ("A", "C"), ("C", "B"), ("D", None), (None, "A")], "p string, n string")
    assert values(df, c.retention(F.col("p"), F.col("n"))) == ["maintain", "upgrade", "downgrade", "lost", None]


def test_sell_type(table):
    df = table([("Comp", 0.0, 25.0), ("Single", 24.0, 25.0), ("Single", 25.0, 25.0), ("Single", 10.0, None)],
               "k string, paid double, price double")
    assert values(df, c.sell_type(F.col("k"), F.col("paid"), F.col("price"))) == ["Comp", "Discount", "Full", None]


def test_timestamps_in_both_text_forms(table):
    df = table([("1/31/2019 8:00:00 PM",), ("7/4/2016 19:30",), ("12/1/2018 12:00:00 AM",), ("soon",)], "t string")
    parsed = c.parse_timestamp(F.col("t"), ("M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm")).cast("string")
    assert values(df, parsed) == ["2019-01-31 20:00:00", "2016-07-04 19:30:00", "2018-12-01 00:00:00", None]


def test_weekdays_here_and_elsewhere(table):
    df = table([("2019-02-01 03:30:00",)], "t string", ["t"])
    t = F.col("t").cast("timestamp")
    assert values(df, c.weekday(t)) == ["Friday"] and values(df, c.weekday(t, "America/Los_Angeles")) == ["Thursday"]
    assert values(df, c.on_weekday(F.col("t"), ["Friday"])) == [True]


def test_text_and_numbers(table):
    df = table([("Orch", "B", "12", 1234567.891, 0.4567, 250.0, 0.0)],
               "s string, r string, n string, x double, p double, v double, z double")
    assert values(df, c.seat_label(F.col("s"), F.col("r"), F.col("n"))) == ["Orch   B - 12"]
    assert values(df, c.dollars(F.col("x"))) == ["$1,234,567.89"] and values(df, c.percent(F.col("p"))) == ["45.7%"]
    assert values(df, c.cap(F.col("v"), 200)) == [200.0]
    assert values(df, c.ratio(F.col("v"), F.col("z"))) == [None] and values(df, c.log_or_null(F.col("z"))) == [None]
    assert values(df, c.days_ago("2019-03-01", 1).cast("string")) == ["2019-02-28"]
