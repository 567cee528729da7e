"""Mixed-format date parsing as one native expression.

The shape of a text (digits as 9, letters as A) is looked up in a map, which tells where
year, month and day stand; the parts are read as numbers and month names, so neither
patterns nor date formatters are tried one after the other, and free text ends at the
lookup. A time of day is taken apart by one pattern and added to the date. Ambiguous
day/month values are read month first, then day first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilgauge import settings
from veilgauge.functions.text import strip

# Order of the parts -> shapes, with {d} for one or two digits and {M} for a month's name.
LAYOUTS = {
    "ymd": ["9999-{d}-{d}", "9999/{d}/{d}", "9999.{d}.{d}"],
    "yyyymmdd": ["99999999"],
    "mdy": ["{d}/{d}/9999", "{d}-{d}-9999", "{d}.{d}.9999", "{d}/{d}/99", "{d}-{d}-99", "{d}.{d}.99"],
    "dMy": ["{d} {M} 9999", "{d}-{M}-9999", "{d} AAA 99", "{d}-AAA-99"],
    "Mdy": ["{M} {d} 9999", "{M} {d}, 9999"],
    "My": ["{M} 9999"],
}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
#: The usual form, which needs no lookup.
ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: two-digit years from here on lie in the last century.
PIVOT_YEAR = 69
#: Date part, then hours, minutes, seconds, fraction, half of the day and offset from UTC.
PARTS = (r"^(.+?)(?:[T ]\s*(\d{1,2}):(\d{2})(?::(\d{2})(\.\d{1,9})?)?\s*([AaPp][Mm])?"
         r"\s*(Z|UTC|[+-]\d{2}:?\d{2})?)?$")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shapes() -> dict[str, str]:
    """Every concrete shape with the order of its parts; shapes with two-digit parts first."""
    found = {}
    for order, patterns in LAYOUTS.items():
        for pattern in patterns:
            pieces = pattern.split("{d}")
            digits = product(("99", "9"), repeat=len(pieces) - 1)
            for chosen in digits:
                filled = "".join(a + b for a, b in zip(pieces, (*chosen, "")))
                for letters in range(3, 10) if "{M}" in filled else [0]:
                    found[filled.replace("{M}", "A" * letters)] = order
    return dict(sorted(found.items(), key=lambda x: x[0].count("A") > 0))


def _map(values: dict) -> Column:
    """A constant map as one expression."""
    return F.expr(f"map({', '.join(f'{key!r}, {value!r}' for key, value in values.items())})")


def _day(text: Column) -> Column:
    """Midnight of the date a text holds; null for any other text."""
    shape = F.translate(text, DIGITS + UPPER + LOWER, "9" * 10 + "A" * 52)
    # The cast of year-month-day is the fastest reader of dates, and knows how long months are.
    at = lambda y, m, d: F.concat(y, F.lit("-"), m, F.lit("-"), d).try_cast("date")
    months = _map({name: str(k) for k, full in enumerate(MONTHS, 1) for name in dict.fromkeys([full[:3], full])})

    def read(parts: Column) -> Column:
        part = lambda k: F.get(parts, F.lit(k))
        order, one, two, last = parts[0], part(1), part(2), part(3)
        year = F.when(F.length(last) > 2, last).when(last >= str(PIVOT_YEAR), F.concat(F.lit("19"), last)).otherwise(
            F.concat(F.lit("20"), last))
        month = lambda name: F.try_element_at(months, F.lower(name))
        return (F.when(order == "ymd", at(one, two, last))
                .when(order == "mdy", F.coalesce(at(year, one, two), at(year, two, one)))
                .when(order == "yyyymmdd", at(F.substring(one, 1, 4), F.substring(one, 5, 2), F.substring(one, 7, 2)))
                .when(order == "dMy", at(year, month(two), one))
                .when(order == "Mdy", at(year, month(one), two))
                .when(order == "My", at(two, month(one), F.lit("1")))).cast("timestamp")

    known = F.when(F.length(text).between(6, 18), F.try_element_at(_map(_shapes()), shape))
    split = F.concat(F.array(known), F.split(text, "[^0-9A-Za-z]+"))
    return _bound(F.when(known.isNotNull(), split), read)


def _time(text: Column) -> Column:
    """Microseconds from midnight of the time in a text, offset from UTC taken off; null if it is no time."""
    part = lambda k: F.regexp_extract(text, PARTS, k)
    number = lambda c: F.when(c != "", c.cast("int")).otherwise(F.lit(0))
    hour, minute, second, half, offset = number(part(2)), number(part(3)), number(part(4)), F.lower(part(6)), part(7)
    half_fits = (half == "") | hour.between(1, 12)
    hour = F.when(half == "pm", hour % 12 + 12).when(half == "am", hour % 12).otherwise(hour)
    digits = F.regexp_replace(offset, "[:+-]", "")
    east = F.when(offset.rlike(r"\d"), F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")).otherwise(F.lit(0))
    east = F.when(offset.startswith("-"), -east).otherwise(east)
    micros = F.rpad(F.substring(part(5), 2, 6), 6, "0")
    micros = F.when(part(5) != "", micros.cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    fits = half_fits & hour.between(0, 23) & (minute < 60) & (second < 60) & (part(2) != "")
    seconds = (hour * 3600 + minute * 60 + second - east * 60).cast("bigint")
    return F.when(fits, seconds * 1_000_000 + micros)


def parse_mixed(c: Column) -> Column:
    """Timestamp for any supported date, with or without a time of day; null for everything else.

    White space around it doesn't count. Offsets are taken off, so results are in UTC.
    """
    def parsed(text: Column) -> Column:
        timed = text.contains(":")
        day = _bound(F.when(timed, F.regexp_extract(text, PARTS, 1)).otherwise(text), _day)
        return F.when(text.rlike(ISO), text.try_cast("date").cast("timestamp")).when(text.rlike("[0-9]"), F.when(timed, F.timestamp_micros(F.unix_micros(day) + _time(text))).otherwise(day))

    return _bound(strip(c), parsed)


def date_like(c: Column) -> Column:
    """True where the text contains something that reads like a date."""
    return c.rlike(settings.DATE_LIKE)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
