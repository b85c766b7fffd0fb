"""Parcel numbers, addresses and road keys out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hanok.functions.months import col, let
from hanok.functions.text import clean, compat
from hanok.functions.values import integer

LOT = r"([0-9]{1,4}(?:-[0-9]{1,4})?)"


def _or_null(extracted) -> Column:
    return F.nullif(extracted, F.lit(""))


def parcel(main, sub) -> Column:
    """``12`` or ``12-3`` without leading zeros; a blank sub number counts as none, a bad number gives null."""
    a = integer(main)
    s = F.coalesce(F.nullif(clean(sub), F.lit("")), F.lit("0"))
    b = integer(s)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat_ws("-", a.cast("string"), F.when(b != 0, b.cast("string"))))


def parcel_from_detail(detail) -> Column:
    """Parcel of a free address text, only where it is unambiguous; otherwise the empty text."""
    s = F.trim(F.coalesce(compat(col(detail)), F.lit("")))
    return F.coalesce(
        _or_null(F.regexp_extract(s, r"(?<![0-9])" + LOT + r"\s*번지(?:\s|$)", 1)),
        _or_null(F.regexp_extract(s, "^" + LOT + "$", 1)),
        _or_null(F.regexp_extract(s, r"[가-힣]+동\s*" + LOT + "$", 1)),
        F.lit(""),
    )


def parcel_from_address(address, region, dong) -> Column:
    """Parcel that follows the dong in a standard address naming both region and dong; otherwise the empty text."""
    s = F.trim(F.coalesce(compat(col(address)), F.lit("")))
    r, d = clean(region), clean(dong)
    tail = F.trim(F.substr(s, F.instr(s, d) + F.length(d)))
    found = F.regexp_extract(tail, r"^(?:산\s*)?" + LOT + r"(?:\s|번지|$)", 1)
    usable = (r != "") & (d != "") & F.contains(s, r) & F.contains(s, d)
    return F.when(usable, found).otherwise("")


def parcel_evidence(detail, address, region, dong) -> Column:
    """Struct (parcel, evidence): the address alone is never trusted, a contradiction gives no parcel."""
    def judge(p):
        a, b = p["a"], p["b"]
        evidence = (
            F.when((a != "") & (b != "") & (a != b), "conflict")
            .when((a != "") & (b != ""), "daddr+stdg_addr")
            .when(a != "", "daddr")
            .when(b != "", "stdg_addr_only_untrusted")
            .otherwise("none")
        )
        return F.struct(F.when((b == "") | (a == b), a).otherwise("").alias("parcel"), evidence.alias("evidence"))

    found = F.struct(parcel_from_detail(detail).alias("a"), parcel_from_address(address, region, dong).alias("b"))
    return let(found, judge)


def legal_parcels(address, eup, dong) -> Column:
    """Distinct (kind, parcel) pairs of a comma-separated address, mountain lots flagged ``2``."""
    place = F.concat_ws(" ", F.nullif(clean(eup), F.lit("")), F.nullif(clean(dong), F.lit("")))
    pattern = F.concat(F.lit(r"\Q"), place, F.lit(r"\E\s+(산\s*)?([0-9]{1,4})(?:-([0-9]{1,4}))?(?=\s|$)"))

    def lot(part):
        def group(i):
            return F.call_function("regexp_extract", part, pattern, F.lit(i))

        return F.when(
            group(2) != "",
            F.struct(F.when(group(1) != "", "2").otherwise("1").alias("kind"), parcel(group(2), group(3)).alias("parcel")),
        )

    found = F.transform(F.split(clean(address), ","), lot)
    found = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    return F.when(place != "", found).otherwise(F.filter(found, lambda x: F.lit(False)))


def road_key(address) -> Column:
    """Struct (road, main, sub) of the first road number in an address, null when there is none."""
    pattern = r"([가-힣A-Za-z0-9·]+(?:대로|로|길))\s+([0-9]+)(?:-([0-9]+))?"
    a = F.coalesce(col(address), F.lit(""))
    name = F.regexp_extract(a, pattern, 1)
    return F.when(
        name != "",
        F.struct(
            name.alias("road"),
            F.regexp_extract(a, pattern, 2).try_cast("int").alias("main"),
            F.coalesce(F.regexp_extract(a, pattern, 3).try_cast("int"), F.lit(0)).alias("sub"),
        ),
    )


def pnu_identity(pnu, moved_in) -> Column:
    """Struct (district, dong, kind, parcel, year) of a 19-digit parcel id, null when id or year is unusable."""
    p = clean(pnu)
    year = integer(F.substring(clean(moved_in), 1, 4))
    return F.when(
        p.rlike("^[0-9]{19}$") & year.isNotNull(),
        F.struct(
            F.substring(p, 1, 5).alias("district"),
            F.substring(p, 6, 5).alias("dong"),
            F.substring(p, 11, 1).alias("kind"),
            parcel(F.substring(p, 12, 4), F.substring(p, 16, 4)).alias("parcel"),
            year.cast("int").alias("year"),
        ),
    )
