"""Calendar-month arithmetic. A month is the string ``YYYY-MM`` or its index ``year * 12 + month - 1``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn) -> Column:
    """``fn`` applied to a value that is computed once, however often ``fn`` mentions it."""
    return F.get(F.transform(F.array(value), fn), 0)


def once(df: DataFrame, *columns: Column, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and new columns that are computed once a row: filters on them are not pushed below, where each mention would
    compute them again."""
    # the outer form always gives its one row, so no filter on the array is inferred either
    return df.select(*keep, F.inline_outer(F.array(F.struct(*columns))))


def month_index(ym: str) -> int:
    year, month = ym.split("-")
    return int(year) * 12 + int(month) - 1


def month_name(index: int) -> str:
    return f"{index // 12:04d}-{index % 12 + 1:02d}"


def midx_of_date(date) -> Column:
    d = col(date)
    return F.year(d) * 12 + F.month(d) - 1


def midx(ym) -> Column:
    """Month index of a ``YYYY-MM`` column; null for any other text."""
    c = col(ym)
    parsed = F.substring(c, 1, 4).try_cast("int") * 12 + F.substring(c, 6, 2).try_cast("int") - 1
    return F.when(c.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"), parsed)


def ym_of(index) -> Column:
    i = col(index)
    return F.format_string("%04d-%02d", F.floor(i / 12).cast("int"), (F.pmod(i, F.lit(12)) + 1).cast("int"))


def ym_of_date(date) -> Column:
    return F.date_format(col(date), "yyyy-MM")


def shift(ym, delta) -> Column:
    return ym_of(midx(ym) + delta)


def month_gap(later, earlier) -> Column:
    """Calendar months between two dates, day ignored."""
    return midx_of_date(later) - midx_of_date(earlier)


def months_between_inclusive(start, end) -> Column:
    """Array of the ``YYYY-MM`` months from start to end; null when start is after end."""
    first, last = midx(start), midx(end)
    return F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), ym_of))


def later(a, b) -> Column:
    return F.greatest(col(a), col(b))


def seoul_time(utc_ntz) -> Column:
    """Wall time in Seoul of a UTC wall time, whatever the session zone is."""
    return F.convert_timezone(F.lit("UTC"), F.lit("Asia/Seoul"), col(utc_ntz).cast("timestamp_ntz"))


def last_closed_month(utc_ntz) -> Column:
    """The month before the one that is running in Seoul at the given UTC instant."""
    return ym_of(midx_of_date(seoul_time(utc_ntz)) - 1)


def seoul_date_of_epoch_ms(millis) -> Column:
    """Seoul calendar date of an epoch-milliseconds number."""
    base = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    seconds = (col(millis).cast("decimal(20,0)") / 1000).cast("decimal(18,6)")
    return (base + F.make_dt_interval(F.lit(0), F.lit(9), F.lit(0), seconds)).cast("date")


def refresh_start(previous, configured, end, full, verified) -> Column:
    """First month to collect again: the twelve latest closed months, or more if the last snapshot is older."""
    window = F.least(midx(end) - 11, midx(previous) + 1)
    usable = (~col(full)) & col(verified) & midx(previous).isNotNull()
    return F.when(F.coalesce(usable, F.lit(False)), F.greatest(col(configured), ym_of(window))).otherwise(col(configured))


def is_due(event, published, closed) -> Column:
    """Whether a run is due: manual always, timed or pushed when the snapshot lags, anything else never."""
    lagging = midx(published).isNull() | (col(published) < col(closed))
    return F.when(col(event) == "workflow_dispatch", True).when(col(event).isin("schedule", "push"), lagging).otherwise(False)
