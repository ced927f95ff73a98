"""Named trip derivations (Column -> Column).

Each function takes column names (defaults are the raw/enriched names)
and returns a built-in Catalyst expression.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cabflow.functions.core import col, safe_div

# ---------------------------------------------------------------------------
# These must equal the source analysis for equal results.
# ---------------------------------------------------------------------------
KM_PER_MILE = 1.609344
SECONDS_PER_MINUTE = 60.0
SECONDS_PER_HOUR = 3600.0
UNKNOWN_COMPANY = "Independent / Unknown"
# Community-area numbers of the two airports.
MIDWAY_AREA = 56
OHARE_AREA = 76
AIRPORT_AREAS = (56, 76)
# Payment categories and the lower-case payment words that select them.
# First match wins, in this order.
CARD_SUBSTRINGS = ("card", "prepaid", "way2ride")
CASH_WORDS = ("cash",)
MOBILE_WORDS = ("mobile",)
NO_CHARGE_WORDS = ("no charge", "dispute")
CARD, CASH, MOBILE, NO_CHARGE, OTHER = (
    "Card",
    "Cash",
    "Mobile",
    "No Charge/Dispute",
    "Other/Unknown",
)
# A trip total may differ from the sum of its parts by at most this much.
TOTAL_TOLERANCE = 1.0
# Week days as numbered by DAYOFWEEK: 1 = Sunday ... 7 = Saturday.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
# Seasons by month number.
WINTER_MONTHS = (12, 1, 2)
SPRING_MONTHS = (3, 4, 5)
SUMMER_MONTHS = (6, 7, 8)
# Airport segment and airport labels.
AIRPORT_PICKUP, AIRPORT_DROPOFF, NON_AIRPORT = "Airport Pickup", "Airport Dropoff", "Non-Airport"
OHARE, MIDWAY, CITY = "OHare", "Midway", "City"
# ---------------------------------------------------------------------------

# Trailing dots and whitespace, with whitespace as the RE2 class \s
# (tab, newline, form feed, carriage return, space) so that Java regex
# matches what the source engine strips; \z, as Java's $ also matches
# before a final line end.
TRAILING_DOTS_SPACE = r"[.\t\n\f\r ]+\z"
# Unicode White_Space (as a full TRIM strips it): the C0 spaces, NEL and
# every separator (Zs, Zl, Zp). Valid in Java regex and RE2.
UNICODE_SPACE = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
UNICODE_TRIM = rf"\A{UNICODE_SPACE}+|{UNICODE_SPACE}+\z"


def unicode_trim(c: Column | str) -> Column:
    return F.regexp_replace(col(c), UNICODE_TRIM, "")


def partition_month(ts: Column | str = "trip_start_timestamp") -> Column:
    """First day of the trip's month (DATE)."""
    return F.trunc(F.to_date(col(ts)), "month")


def company_clean(company: Column | str = "company") -> Column:
    """Firm name without trailing dots/space, trimmed; NULL -> 'Independent / Unknown'."""
    c = col(company)
    return F.when(c.isNull(), F.lit(UNKNOWN_COMPANY)).otherwise(
        unicode_trim(F.regexp_replace(c, TRAILING_DOTS_SPACE, ""))
    )


def trip_km(miles: Column | str = "trip_miles") -> Column:
    return col(miles) * F.lit(KM_PER_MILE)


def duration_min(seconds: Column | str = "trip_seconds") -> Column:
    return safe_div(seconds, F.lit(SECONDS_PER_MINUTE))


def duration_hr(seconds: Column | str = "trip_seconds") -> Column:
    return safe_div(seconds, F.lit(SECONDS_PER_HOUR))


def avg_speed_kmh(miles: Column | str = "trip_miles", seconds: Column | str = "trip_seconds") -> Column:
    return safe_div(trip_km(miles), duration_hr(seconds))


def dollars_per_km(total: Column | str = "trip_total", miles: Column | str = "trip_miles") -> Column:
    return safe_div(total, trip_km(miles))


def dollars_per_min(total: Column | str = "trip_total", seconds: Column | str = "trip_seconds") -> Column:
    return safe_div(total, duration_min(seconds))


def component_sum(
    fare: Column | str = "fare",
    tips: Column | str = "tips",
    tolls: Column | str = "tolls",
    extras: Column | str = "extras",
) -> Column:
    """fare + tips + tolls + extras with NULL parts as 0 (never NULL)."""
    zero = F.lit(0.0)
    return (
        F.coalesce(col(fare), zero)
        + F.coalesce(col(tips), zero)
        + F.coalesce(col(tolls), zero)
        + F.coalesce(col(extras), zero)
    )


def component_gap(total: Column | str = "trip_total") -> Column:
    return col(total) - component_sum()


def has_geo(pickup: Column | str = "pickup_community_area", dropoff: Column | str = "dropoff_community_area") -> Column:
    return col(pickup).isNotNull() & col(dropoff).isNotNull()


def is_airport_trip(
    pickup: Column | str = "pickup_community_area", dropoff: Column | str = "dropoff_community_area"
) -> Column:
    """Three-valued: NULL when one area is unknown and the other is not an airport."""
    return col(pickup).isin(*AIRPORT_AREAS) | col(dropoff).isin(*AIRPORT_AREAS)


def is_total_consistent(total: Column | str = "trip_total") -> Column:
    """Total present and within $1 of its parts (never NULL)."""
    t = col(total)
    return t.isNotNull() & (F.abs(t - component_sum()) <= F.lit(TOTAL_TOLERANCE))


def payment_category(payment_type: Column | str = "payment_type") -> Column:
    """Five categories, never NULL; unknown words and NULL are 'Other/Unknown'."""
    p = F.lower(col(payment_type))
    card = None
    for word in CARD_SUBSTRINGS:
        hit = p.contains(word)
        card = hit if card is None else (card | hit)
    return (
        F.when(card, F.lit(CARD))
        .when(p.isin(*CASH_WORDS), F.lit(CASH))
        .when(p.isin(*MOBILE_WORDS), F.lit(MOBILE))
        .when(p.isin(*NO_CHARGE_WORDS), F.lit(NO_CHARGE))
        # 'unknown', 'split', NULL and any other word all land here.
        .otherwise(F.lit(OTHER))
    )


def day_name(day_of_week: Column | str = "day_of_week") -> Column:
    d = col(day_of_week)
    expr = None
    for number, name in enumerate(DAY_NAMES, start=1):
        expr = F.when(d == number, F.lit(name)) if expr is None else expr.when(d == number, F.lit(name))
    return expr


def month_name(month_start: Column | str = "month_start") -> Column:
    """English month name of a date (``FORMAT_DATE('%B')``)."""
    return F.date_format(col(month_start), "MMMM")


def season(month_num: Column | str) -> Column:
    m = col(month_num)
    return (
        F.when(m.isin(*WINTER_MONTHS), F.lit("Winter"))
        .when(m.isin(*SPRING_MONTHS), F.lit("Spring"))
        .when(m.isin(*SUMMER_MONTHS), F.lit("Summer"))
        .otherwise(F.lit("Autumn"))
    )


def airport_segment(
    pickup: Column | str = "pickup_community_area", dropoff: Column | str = "dropoff_community_area"
) -> Column:
    """Pickup at an airport beats dropoff at one."""
    return (
        F.when(col(pickup).isin(*AIRPORT_AREAS), F.lit(AIRPORT_PICKUP))
        .when(col(dropoff).isin(*AIRPORT_AREAS), F.lit(AIRPORT_DROPOFF))
        .otherwise(F.lit(NON_AIRPORT))
    )


def airport_name(
    pickup: Column | str = "pickup_community_area", dropoff: Column | str = "dropoff_community_area"
) -> Column:
    """O'Hare at either end beats Midway."""
    p, d = col(pickup), col(dropoff)
    return (
        F.when((p == OHARE_AREA) | (d == OHARE_AREA), F.lit(OHARE))
        .when((p == MIDWAY_AREA) | (d == MIDWAY_AREA), F.lit(MIDWAY))
        .otherwise(F.lit(CITY))
    )
