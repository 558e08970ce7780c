"""Presentation as columns: money, rates, compact counts, bars, glyphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(value: Column) -> Column:
    """A decimal amount with 2 places from 1 up, 4 from a cent up, else 6; half to even."""
    size = F.abs(value)

    def places(n: int) -> Column:
        return F.bround(value, n).cast(f"decimal(38,{n})").cast("string")

    return F.when(size >= 1, places(2)).when(size >= F.lit("0.01").cast("decimal(3,2)"), places(4)).otherwise(places(6))


CURRENCIES = ("USD", "EUR", "CZK")
RFC3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"


def currency(code: Column) -> Column:
    """The code of a known currency, whatever its case; NULL for others."""
    return F.when(F.upper(code).isin(*CURRENCIES), F.upper(code))


def stored_time(at: Column) -> Column:
    """An instant in UTC as text of fixed width, cut to milliseconds."""
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local_minute(text: Column, zone: str) -> Column:
    """A stored instant as the minute it fell in locally; what is no instant is shown as it is, cut short."""
    at = F.when(text.rlike(RFC3339), F.try_to_timestamp(text))
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), at.cast("timestamp_ntz"))
    return F.coalesce(F.date_format(local, "yyyy-MM-dd HH:mm"), F.substring(F.replace(text, F.lit("T"), F.lit(" ")), 1, 16))


def rate(nano: Column) -> Column:
    """A rate of whole 1e-9 units with two decimals at least; further ones are never dropped."""
    exact = (nano.cast("decimal(19,0)") * F.lit("0.000000001").cast("decimal(9,9)")).cast("decimal(28,9)")
    return F.regexp_replace(exact.cast("string"), "0{1,7}$", "")


def money_text(value: Column, kind: Column, code: Column) -> Column:
    """An amount with its certainty and currency, or a dash."""
    sign = F.when(kind.isin("calculated", "estimated"), "≈").when(kind == "partial", "≥").otherwise("")
    return F.when(value.isNull(), "—").otherwise(F.concat(sign, symbol(code), money(value)))


def rate_sentence(as_of: Column, source: Column, code: Column, age_days: Column, stale_days: int = 7) -> Column:
    """How old an exchange rate is, where it is from, and that old ones make amounts approximate."""
    day = F.date_format(as_of, "yyyy-MM-dd")
    # fixed values: the three sentences are what reports say
    old = F.format_string("FX rate %d days old, from %s (%s). Amounts shown in %s are approximate.", age_days, day, source, code)
    return F.when(as_of.isNull(), "No exchange rate available.").when(age_days >= stale_days, old).otherwise(F.format_string("FX rate updated %s (%s).", day, source))


def symbol(currency: Column) -> Column:
    return F.when(currency == "EUR", "€").when(currency == "CZK", "Kč").otherwise("$")


def compact(n: Column) -> Column:
    """1234 as 1k: whole steps of a thousand up to E."""
    out = n.cast("string")
    for letter, power in zip("kMGTPE", range(3, 21, 3), strict=True):
        unit = F.lit(10**power).cast("long")
        out = F.when(n >= unit, F.concat(F.floor(n / unit).cast("string"), F.lit(letter))).otherwise(out)
    return out


def bar(value: Column, peak: Column, width: int) -> Column:
    """A bar in proportion to the peak, of one cell at least for what is not zero."""
    cells = F.round(value / F.greatest(peak, F.lit(1)) * width).cast("int")
    return F.when(value > 0, F.expr("repeat('█', 1)")).otherwise("") if width == 1 else F.when(value > 0, F.repeat(F.lit("█"), F.greatest(cells, F.lit(1)))).otherwise("")


def glyph(level: Column) -> Column:
    return F.element_at(F.array(F.lit("·"), F.lit("▪"), F.lit("▪"), F.lit("■"), F.lit("■")), level + 1)


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)
