"""HTML listings: rows of a page with the file they offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a listing row of each source looks like.
ARCHIVE_ROW = r"(?s)<tr\b[^>]*>.*?</tr>"
ARCHIVE_YEAR = r"서울특별시_전월세가_([0-9]{4})\.zip"
ARCHIVE_SEQ = r"downloadFile\('([0-9]+)'\)"
ARCHIVE_STAMP = r"(20[0-9]{2}\.[0-9]{2}\.[0-9]{2}\.)"
BOARD_ROW = r"(?s)<(li|tr)\b[^>]*>.*?</\1\s*>"
BOARD_WORDS = ("관리비공개의무단지", "기본정보")
BOARD_FILE = r"""fileDown\(['"]([0-9]+)['"],\s*['"]03['"],\s*['"]([0-9]+)['"]"""
BOARD_DATE = r"(20[0-9]{2})[.-]([0-9]{2})[.-]([0-9]{2})"


def blocks(pages: DataFrame, html: str, pattern: str, *keep: str) -> DataFrame:
    """One row per match of ``pattern`` in the page, in page order."""
    found = F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)))
    return pages.select(*keep, found.alias("pos", "block"))


def _group(c, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def archive_index(pages: DataFrame, html: str = "html", page_order: str | None = None) -> DataFrame:
    """Yearly archives offered: year, download number, publication stamp; the last row of a year wins.

    ``page_order`` orders the pages of a listing that has several.
    """
    page = F.col(page_order) if page_order else F.lit(0)
    numbered = pages.select(page.alias("page"), html)
    rows = blocks(numbered, html, ARCHIVE_ROW, "page").select(
        F.struct("page", "pos").alias("at"), _group("block", ARCHIVE_YEAR, 1).cast("int").alias("year"),
        _group("block", ARCHIVE_SEQ, 1).alias("seq"), F.regexp_extract("block", ARCHIVE_STAMP, 1).alias("published"),
    )
    kept = rows.filter("year is not null and seq is not null")
    return kept.groupBy("year").agg(F.max_by(F.struct("seq", "published"), "at").alias("r")).select("year", "r.*")


def latest_attachment(pages: DataFrame, html: str = "html") -> DataFrame:
    """The most recent attachment of the wanted kind: date, seq, number (no row when there is none)."""
    rows = blocks(pages, html, BOARD_ROW)
    for word in BOARD_WORDS:
        rows = rows.filter(F.contains("block", F.lit(word)))
    date = F.concat_ws("-", *[_group("block", BOARD_DATE, i) for i in (1, 2, 3)])
    listed = rows.select(date.alias("date"), _group("block", BOARD_FILE, 1).alias("seq"), _group("block", BOARD_FILE, 2).alias("number"))
    listed = listed.filter("seq is not null and date <> ''")
    return listed.agg(F.max(F.struct("date", "seq", "number")).alias("m")).select("m.*").filter("date is not null")
