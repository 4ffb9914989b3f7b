"""Column expressions: the derived business columns every report shares.

All are built-in expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price types as they appear in the extracts ('Single ' carries a trailing blank).
RAW_SINGLE = "Single "
RAW_DISCOUNT = "Discount"
RAW_SUBSCRIPTION = "Subscription"
RAW_FLEX = "Flex"
RAW_COMP = "Comp"
SOLD_TYPES = (RAW_SINGLE, RAW_DISCOUNT, RAW_SUBSCRIPTION, RAW_FLEX, RAW_COMP)
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Lower bounds and labels of the five-year giving bands.
GIVING_BANDS_8 = ((500_000, "A"), (250_000, "B"), (100_000, "C"), (50_000, "D"), (10_000, "E"), (1_000, "F"), (10, "G"))
# Upper bounds of the four-way giving bands.
GIVING_BANDS_4 = ((1_000, "A"), (10_000, "B"), (100_000, "C"))
# Last birth year of each age group, and last age of each decade.
BIRTH_YEAR_GROUPS = ((1954, "group_65_and_older"), (1974, "group_45_to_64"))
AGE_DECADES = ((19, "less20"), (29, "twenties"), (39, "thirties"), (49, "fourties"), (59, "fifties"),
               (69, "sixties"), (79, "seventies"), (89, "eighties"), (99, "nineties"))
# Segment labels.
AFICIONADO = "Aficionado"
LOW_BUDGET = "Committed low-budget"
EVOLVING = "Evolving concert-goer"
PROSPECT = "High-value prospect"
ONE_TIMER = "One-timer"
REGULAR = "High-value regular"


def cascade(subject: Column, cases: Sequence[tuple[Column, str | Column]], otherwise: str | Column | None) -> Column:
    """First matching case wins; an unknown subject stays unknown instead of taking the last branch."""
    expr = F.when(subject.isNull(), F.lit(None))
    for condition, value in cases:
        expr = expr.when(condition, value)
    return expr.otherwise(otherwise)


def upper_bounded(value: Column, bounds: Sequence[tuple[float, str]], beyond: str, inclusive: bool) -> Column:
    """Label by the first upper bound that holds the value."""
    return cascade(value, [((value <= b) if inclusive else (value < b), label) for b, label in bounds], beyond)


# --- dates ---------------------------------------------------------------------------------------------------


def fiscal_year(ts: Column, first: int | None = None, last: int | None = None) -> Column:
    """July to June, named by the year it ends in; optionally clamped to a range."""
    fy = F.year(F.add_months(ts, 6))
    if first is not None:
        fy = F.greatest(fy, F.lit(first))
    if last is not None:
        fy = F.least(fy, F.lit(last))
    return fy.cast("int")


def _two_digits(year: Column) -> Column:
    return F.lpad((year % 100).cast("string"), 2, "0")


def season_label(fy: Column) -> Column:
    """'PS 13-14' for fiscal year 2014."""
    return F.concat(F.lit("PS "), _two_digits(fy - 1), F.lit("-"), _two_digits(fy))


def short_fiscal_label(fy: Column) -> Column:
    """'fy19' for fiscal year 2019."""
    return F.concat(F.lit("fy"), _two_digits(fy))


def campaign_season(campaign: Column) -> Column:
    return F.substring(campaign, 1, 8)


def weekday(ts: Column, zone: str | None = None) -> Column:
    """Weekday name; a table lookup, so no text formatting per row."""
    local = F.from_utc_timestamp(ts, zone) if zone else ts
    return F.element_at(F.array(*[F.lit(day) for day in WEEKDAYS]), F.weekday(local) + 1)


def on_weekday(ts: Column, days: Sequence[str]) -> Column:
    """Whether the date falls on one of the named weekdays (compared as numbers)."""
    return F.weekday(ts).isin(*[WEEKDAYS.index(day) for day in days])


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "MM")


def parse_timestamp(text: Column, formats: Sequence[str]) -> Column:
    """The first format that fits; unparseable text becomes NULL."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(fmt)) for fmt in formats])


def parse_date(text: Column, fmt: str = "M/d/yyyy") -> Column:
    return F.to_date(text, fmt)


def days_ago(as_of: str, days: int) -> Column:
    return F.date_sub(F.lit(as_of).cast("date"), days)


# --- tickets -------------------------------------------------------------------------------------------------


def price_zone(zone_desc: Column) -> Column:
    return F.substring(zone_desc, 1, 7)


def price_type(raw: Column) -> Column:
    """Single, Subscription, Flex, Comp, and everything else is an unsold seat."""
    return cascade(raw, [
        (raw.isin(RAW_SINGLE, RAW_DISCOUNT), "Single"),
        (raw.isin(RAW_SUBSCRIPTION, RAW_FLEX, RAW_COMP), raw),
    ], "Unsold")


def report_price_type(raw: Column) -> Column:
    """Flex counts as subscription and discounts as singles; other types keep their trimmed name."""
    return cascade(raw, [
        (raw == RAW_FLEX, F.lit(RAW_SUBSCRIPTION)),
        (raw == RAW_DISCOUNT, F.lit(RAW_SINGLE.strip())),
    ], F.trim(raw))


def subscription_or_single(raw: Column) -> Column:
    """Subscription and Flex against everything else."""
    return cascade(raw, [(raw.isin(RAW_SUBSCRIPTION, RAW_FLEX), "Subscription")], "Single")


def single_or_subscription(raw: Column) -> Column:
    """Single and Discount against everything else."""
    return cascade(raw, [(raw.isin(RAW_SINGLE, RAW_DISCOUNT), "Single")], "Subscription")


def is_subscription(raw: Column) -> Column:
    return raw.isin(RAW_SUBSCRIPTION, RAW_FLEX)


def is_single(raw: Column) -> Column:
    return raw.isin(RAW_SINGLE, RAW_DISCOUNT)


def attended_flag(attended: Column) -> Column:
    return F.when(attended == "Attended", 1).otherwise(0)


def sell_type(price_type_group: Column, paid: Column, list_price: Column) -> Column:
    """Comp, Discount (below the list price) or Full; unknown without a list price."""
    return F.when(price_type_group == RAW_COMP, RAW_COMP).otherwise(
        cascade(list_price, [(list_price > paid, "Discount")], "Full"))


def seat_label(section: Column, row: Column, seat: Column) -> Column:
    """Blank-separated parts around blank-padded separators, hence the double blanks."""
    return F.concat_ws(" ", section, F.lit(" "), row, F.lit("-"), seat)


# --- customers -----------------------------------------------------------------------------------------------


def giving_band_8(total: Column) -> Column:
    """Bands A (largest) to H on lower bounds; no donation at all is H."""
    expr = F.when(total.isNull(), "H")
    for bound, label in GIVING_BANDS_8:
        expr = expr.when(total >= bound, label)
    return expr.otherwise("H")


def giving_band_4(total: Column, inclusive: bool = False) -> Column:
    """Bands A (smallest) to D; `inclusive` puts a boundary amount in the lower band."""
    return upper_bounded(total, GIVING_BANDS_4, "D", inclusive)


def age(birth_year: Column, as_of_year: int) -> Column:
    return F.when(birth_year > 0, F.lit(as_of_year) - birth_year)


def age_group(birth_year: Column) -> Column:
    return upper_bounded(F.when(birth_year > 0, birth_year), BIRTH_YEAR_GROUPS, "under_44", inclusive=True)


def age_decade(years: Column) -> Column:
    return upper_bounded(years, AGE_DECADES, "hundreds", inclusive=True)


def segment(avg_paid: Column, freq: Column, price_mid: Column, price_high: Column, freq_mid: Column,
            freq_high: Column, freq_low: Column) -> Column:
    """Customer segment by average price and frequency against population thresholds.

    All comparisons are strict: a customer exactly on a threshold falls through to the last label.
    """
    dear, cheap = avg_paid > price_mid, avg_paid < price_mid
    rare = freq < freq_low
    return (F.when(dear & (freq > freq_high), AFICIONADO)
            .when(cheap & (freq > freq_mid), LOW_BUDGET)
            .when((avg_paid < price_high) & (freq < freq_mid) & (freq > freq_low), EVOLVING)
            .when(dear & rare, PROSPECT)
            .when(cheap & rare, ONE_TIMER)
            .otherwise(REGULAR))


def classification(renew: Column, returning: Column) -> Column:
    return F.when(renew == 1, "renew").when(returning == 1, "return").otherwise("new")


def retention(previous_band: Column, current_band: Column) -> Column:
    """What became of a donor of one year in the next; band letters order by amount."""
    return cascade(previous_band, [
        (current_band.isNull(), "lost"),
        (current_band < previous_band, "downgrade"),
        (current_band == previous_band, "maintain"),
    ], "upgrade")


def tenure_class(held_prior_3: Column, held_prior_1: Column, held_two_before: Column) -> Column:
    """New (nothing in three prior years), second year (prior year only), else multi."""
    return (F.when(~held_prior_3, "new")
            .when(held_prior_1 & ~held_two_before, "second_year")
            .otherwise("multi"))


# --- numbers and text ----------------------------------------------------------------------------------------


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL, not an error, when nothing is counted."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def log_or_null(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def cap(x: Column, limit: float) -> Column:
    return F.when(x.isNotNull(), F.least(x, F.lit(float(limit))))


def dollars(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, 2))


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(x * 100, digits), F.lit("%"))
