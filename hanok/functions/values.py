"""Numbers, dates, display texts and range predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hanok.functions import fixed_values as fv
from hanok.functions.months import col, let, seoul_date_of_epoch_ms
from hanok.functions.text import clean, first_nonblank


def digits(c) -> Column:
    """Text without blanks at its ends and without thousands commas; null becomes the empty text."""
    return F.replace(clean(c), F.lit(","), F.lit(""))


def loose_digits(c) -> Column:
    """As :func:`digits`, percent signs ignored."""
    return digits(F.replace(col(c).cast("string"), F.lit("%"), F.lit("")))


def finite(value: Column, s: Column) -> Column:
    """``value``, the double that the text ``s`` was cast to, if it is a finite number written as such, else null."""
    # a type suffix or a hexadecimal number is no number here; infinities and NaN differ from themselves less zero
    return F.when((value - value == 0) & ~F.lower(F.right(s, F.lit(1))).isin("d", "f") & ~F.contains(s, F.lit("x")), value)


def number(c) -> Column:
    """Finite number from text with thousands commas, else null."""
    s = digits(c)
    return finite(s.try_cast("double"), s)


def loose_number(c) -> Column:
    """As :func:`number`, percent signs ignored."""
    s = loose_digits(c)
    return finite(s.try_cast("double"), s)


def nearest(value: Column) -> Column:
    """Nearest whole number, ties to even."""
    return F.bround(value, 0).cast("bigint")


def whole(c) -> Column:
    """Nearest whole number (ties to even) of a loose number."""
    return nearest(loose_number(c))


def integer(c) -> Column:
    """Whole number of a text that holds nothing else, else null."""
    return F.replace(clean(c), F.lit(","), F.lit("")).try_cast("bigint")


def calendar_date(year, month, day) -> Column:
    """Date of three whole numbers, null when there is no such day."""
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(year, month, day, zero, zero, zero.cast("decimal(8,6)")).cast("date")


def compact_date(c) -> Column:
    """Date of the first eight digits ``yyyyMMdd``, null when invalid."""
    digits = let(F.substring(clean(c), 1, 8), lambda s: F.when(F.length(s) == 8, s.try_cast("int")))
    return let(digits, lambda n: calendar_date(F.floor(n / 10000).cast("int"), F.floor(F.pmod(n, F.lit(10000)) / 100).cast("int"), F.pmod(n, F.lit(100))))


def date_parts(value) -> Column:
    """Runs of digits of a disclosed date; see :func:`date_of_parts`."""
    return F.regexp_extract_all(clean(value), F.lit("([0-9]+)"), F.lit(1))


def date_of_parts(parts: Column, query_year) -> Column:
    n = F.size(parts)
    a, b, c = (F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3))
    full_year = F.when(a < 100, a + 2000).otherwise(a)
    return (
        F.when(n == 2, calendar_date(col(query_year).cast("int"), a, b))
        .when(n == 3, calendar_date(full_year, b, c))
        .when((n == 1) & (F.length(F.get(parts, 0)) == 8), compact_date(F.get(parts, 0)))
    )


def disclosed_date(value, query_year) -> Column:
    """Date of ``MM.DD`` (year of the query), ``YY.MM.DD`` / ``YYYY.MM.DD`` or ``yyyyMMdd``; null when invalid."""
    return let(date_parts(value), lambda parts: date_of_parts(parts, query_year))


def completed(use_date, build_year=None) -> Column:
    """``YYYY.MM`` of an approval date in digits, any punctuation, or KST epoch milliseconds; ``YYYY`` if only that."""
    raw = clean(use_date)
    epoch = F.date_format(seoul_date_of_epoch_ms(F.when(raw.rlike("^[0-9]{11,}$"), raw)), "yyyyMMdd")
    digits = F.coalesce(epoch, F.regexp_replace(raw, "[^0-9]", ""))
    out = F.when(F.length(digits) >= 6, F.concat(F.substring(digits, 1, 4), F.lit("."), F.substring(digits, 5, 2)))
    out = out.when(F.length(digits) >= 4, F.substring(digits, 1, 4))
    if build_year is None:
        return out
    return F.coalesce(out, F.nullif(F.regexp_extract(clean(build_year), "((?:19|20)[0-9]{2})", 1), F.lit("")))


def year_of(text) -> Column:
    """First year of 19xx or 20xx in a text."""
    return F.regexp_extract(F.coalesce(col(text).cast("string"), F.lit("")), "((?:19|20)[0-9]{2})", 1).try_cast("int")


def in_range(value, low=None, high=None) -> Column:
    """Closed range with open ends; a missing value is never inside."""
    v = col(value)
    inside = v.isNotNull()
    if low is not None:
        inside = inside & (v >= low)
    if high is not None:
        inside = inside & (v <= high)
    return F.coalesce(inside, F.lit(False))


def money(value) -> Column:
    """Amount in 10k won shown in units of 10,000 (two decimals at most, no trailing zeros)."""
    hundredths = F.round(col(value).cast("decimal(20,4)") / 10000, 2).cast("decimal(20,2)")
    text = F.regexp_replace(F.regexp_replace(hundredths.cast("string"), "0+$", ""), r"\.$", "")
    return F.coalesce(F.concat(text, F.lit("억")), F.lit("—"))


def signed_money(value) -> Column:
    return F.concat(F.when(col(value) >= 0, "+").otherwise(""), money(value))


def signed_percent(value) -> Column:
    tenths = F.round(col(value).cast("decimal(20,6)"), 1).cast("decimal(20,1)").cast("string")
    return F.concat(F.when(col(value) >= 0, "+").otherwise(""), tenths, F.lit("%"))


def display_name(name, station_display, station=None) -> Column:
    shown = first_nonblank(*[c for c in (station_display, station) if c is not None])
    bare = F.regexp_replace(shown, "역$", "")
    return F.when(bare != "", F.concat(col(name), F.lit("("), bare, F.lit("역)"))).otherwise(col(name))


def station_display(station) -> Column:
    """Station name with its known lines in front."""
    bare = F.replace(clean(station), F.lit("역"), F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in fv.STATION_LINES.items() for x in pair])
    return F.concat(F.coalesce(F.element_at(table, bare), F.lit("")), bare)


def search_url(base: str, name) -> Column:
    """``base`` followed by the percent-encoded name (blank as %20, slash kept)."""
    q = F.url_encode(col(name))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        q = F.replace(q, F.lit(a), F.lit(b))
    return F.concat(F.lit(base), q)


def weight_twentieths(distance) -> Column:
    """Weight of a trade by month distance, in twentieths: whole numbers keep weighted medians exact."""
    d = col(distance)
    out = None
    for limit, weight in fv.WEIGHT_TWENTIETHS:
        cond = d <= limit
        out = F.when(cond, weight) if out is None else out.when(cond, weight)
    return out.otherwise(fv.WEIGHT_FAR_TWENTIETHS)
