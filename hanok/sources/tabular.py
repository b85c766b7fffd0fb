"""CSV and XML scans with several possible column names per field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanok.functions.fixed_values import ARCHIVE_FIELDS
from hanok.functions.months import once
from hanok.functions.text import clean, first_nonblank, folded_header


class SourceError(Exception):
    """A source does not have the expected shape."""


@F.pandas_udf(T.StringType())
def cp949_text(s: pd.Series) -> pd.Series:
    """Text that was read byte by byte (ISO-8859-1), decoded as CP949."""
    return s.map(lambda x: None if x is None else x.encode("latin-1").decode("cp949"))


def _header_encoding(names: Sequence[str]) -> tuple[str, list[str]]:
    """Encoding that turns the byte-wise header into text: UTF-8 (with or without mark), else CP949."""
    for encoding in ("utf-8", "cp949"):
        try:
            return encoding, [n.encode("latin-1").decode(encoding).lstrip("\ufeff").strip() for n in names]
        except UnicodeDecodeError:
            continue
    raise SourceError("unknown text encoding")


def read_archive(spark: SparkSession, path: str, district: str, fields: Mapping[str, str] = ARCHIVE_FIELDS) -> DataFrame:
    """Lease archive CSV: required columns, short names, one district.

    Files are split by bytes, which is safe in both encodings; only the wanted columns of the wanted district are
    decoded.
    """
    quoted = spark.read.option("header", True).option("quote", '"').option("escape", '"')  # a doubled quote is a quote
    raw = quoted.option("encoding", "ISO-8859-1").csv(path)
    encoding, names = _header_encoding(raw.columns)
    absent = [f for f in fields if f not in names]
    if absent:
        raise SourceError(f"archive lacks columns {absent}")
    if encoding == "utf-8":
        raw = quoted.option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*names)
    kept = raw.select(*[F.col(f"`{k}`").alias(v) for k, v in fields.items()]).filter(clean("cgg_cd") == district)
    if encoding == "cp949":
        kept = kept.select(*[cp949_text(c).alias(c) for c in kept.columns])
    return kept


def pick(df: DataFrame, *names: str) -> Column:
    """First non-blank of the columns with these names; headers are compared without blanks, brackets and case."""
    have = {folded_header(c): c for c in reversed(df.columns)}
    found = [F.col(f"`{have[folded_header(n)]}`") for n in names if folded_header(n) in have]
    return first_nonblank(*found) if found else F.lit("")


# The names under which sources give each catalogue field.
CATALOG_NAMES = {
    "district": ("자치구", "SGG_ADDR", "원본_SGG_ADDR", "SGG_NM"),
    "name": ("아파트명", "APT_NM", "원본_APT_NM"),
    "address": ("주소", "APT_RDN_ADDR", "원본_APT_RDN_ADDR", "원본_APT_STDG_ADDR"),
    "complex_id": ("원본_APT_CD", "APT_CD", "단지코드"),
    "households": ("세대수", "TNOHSH", "원본_TNOHSH", "TOT_HSHLD_CO"),
    "use_date": ("준공일자", "사용승인일", "원본_USE_APRV_YMD", "USE_APRV_YMD"),
    "build_year": ("건축연도", "build_year", "BUILD_YEAR"),
    "station": ("가장가까운지하철역", "nearest_station", "지하철역"),
    "station_distance_km": ("지하철역거리_km", "station_distance_km"),
    "lat": ("위도", "LAT", "Y"),
    "lon": ("경도", "LNG", "LON", "X"),
    "legal_dong": ("원본_EMD_ADDR", "EMD_ADDR"),
}


def catalog_table(rows: DataFrame, regions: Sequence[str], order: str | None = None, codes: Mapping[str, str] | None = None) -> DataFrame:
    """Legacy metadata rows as a catalogue: aliased columns, first row per (region, normalised name, address).

    With ``codes`` (region to district code) a complex without an id is named by code and position within its region.
    """
    from hanok.functions.text import norm_name
    from hanok.functions.values import completed, loose_number, station_display, whole

    texts = rows.select(*[pick(rows, *names).alias(f) for f, names in CATALOG_NAMES.items()], *([F.col(order).alias("ord")] if order else [F.monotonically_increasing_id().alias("ord")]))
    region = F.get(F.filter(F.array(*[F.lit(r) for r in regions]), lambda r: F.contains(F.col("district"), r)), 0)
    placed = texts.withColumn("region", region).filter("region is not null and name <> ''")
    done = completed("use_date", "build_year")
    year = F.coalesce(whole("build_year"), F.substring(done, 1, 4).try_cast("bigint")).cast("int")
    station = F.replace("station", F.lit("역"), F.lit(""))
    typed = placed.select(
        "ord", "region", "name", "address", "complex_id", whole("households").cast("int").alias("households"), done.alias("completed"),
        year.alias("build_year"), station.alias("station"), station_display("station").alias("station_display"),
        loose_number("station_distance_km").alias("station_distance_km"), loose_number("lat").alias("lat"), loose_number("lon").alias("lon"),
        "legal_dong", norm_name("name").alias("_n"),
    )
    fields = [c for c in typed.columns if c not in ("region", "_n", "address")]
    first = typed.groupBy("region", "_n", "address").agg(F.min_by(F.struct(*fields), "ord").alias("f"))
    out = first.select("region", "address", "f.*")
    if codes is None:
        return out
    # positions are those of complexes, of which a region holds thousands at most
    code = F.element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), F.col("region"))
    position = F.row_number().over(Window.partitionBy("region").orderBy("ord"))
    return out.withColumn("complex_id", F.coalesce(F.nullif("complex_id", F.lit("")), F.concat(code, F.lit("-meta-"), position.cast("string"))))


def catalog_violations(catalog: DataFrame, regions: Sequence[str], least: int = 20) -> DataFrame:
    """Regions of which the metadata holds too few complexes, absent ones included."""
    from hanok.operators import guards

    floors = catalog.sparkSession.createDataFrame([(r, least) for r in regions], "region string, least int")
    return guards.minimum_rows_by(catalog, "region", floors, "metadata_too_small")


# The tag names of each field of a trade item.
ITEM_NAMES = {
    "name": ("aptNm", "아파트"), "area": ("excluUseAr", "전용면적"), "floor": ("floor", "층"), "price": ("dealAmount", "거래금액"),
    "year": ("dealYear", "년"), "month": ("dealMonth", "월"), "day": ("dealDay", "일"),
    "deal_type": ("dealingGbn", "거래유형"), "cancel_type": ("cdealType", "해제여부"), "cancel_day": ("cdealDay", "해제사유발생일"),
    "legal_dong": ("umdNm", "법정동"), "jibun": ("jibun", "지번"), "apt_seq": ("aptSeq", "단지일련번호", "아파트일련번호"), "build_year": ("buildYear", "건축년도"),
}
DIRECT_DEAL = "직거래"
NOT_CANCELLED = ("", "0", "N", "해제아님")


def write_items(items: DataFrame, path: str, row_tag: str = "item", file_rows: int = 100_000) -> None:
    """Items as XML responses. The tags make most of an item's bytes, so the files are compressed; one task reads a whole
    file, so its length is bounded."""
    out = items.write.format("xml").option("rootTag", f"{row_tag}s").option("rowTag", row_tag)
    out.option("compression", "gzip").option("maxRecordsPerFile", file_rows).save(path)


def read_items(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """All items of XML responses as text columns, whichever of its tag names each field uses."""
    tags = [t for names in ITEM_NAMES.values() for t in names]
    schema = T.StructType([T.StructField(t, T.StringType()) for t in tags])
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    return raw.select(*[first_nonblank(*[F.col(f"`{n}`") for n in names]).alias(f) for f, names in ITEM_NAMES.items()])


def item_trades(items: DataFrame) -> DataFrame:
    """Typed legacy trades: no direct deals, nothing cancelled, complete, within the two collected area bands."""
    from hanok.functions.values import finite, loose_digits, nearest, whole

    live = ~F.contains("deal_type", F.lit(DIRECT_DEAL)) & (F.col("cancel_day") == "") & F.col("cancel_type").isin(*NOT_CANCELLED)
    kept, numbers = ["name", "legal_dong", "jibun", "apt_seq", "build_year"], ["area", "floor", "price", "year", "month", "day"]
    # text, then double, then value, each a column that the next step only names: generated code stays short enough to be compiled
    texts = items.filter(live).select(*kept, *[loose_digits(f).alias(f) for f in numbers])
    doubles = texts.select("*", *[F.col(f).try_cast("double").alias(f"{f}_double") for f in numbers])
    value = {f: finite(F.col(f"{f}_double"), F.col(f)) for f in numbers}
    typed = once(
        doubles, value["area"].alias("area"), nearest(value["floor"]).cast("int").alias("floor"), nearest(value["price"]).alias("price"),
        nearest(value["year"]).alias("y"), nearest(value["month"]).alias("m"), nearest(value["day"]).alias("d"), keep=kept,
    )
    complete = (F.col("name") != "") & F.col("area").isNotNull() & F.col("floor").isNotNull()
    for c in ("price", "y", "m", "d"):
        complete = complete & (F.coalesce(F.col(c), F.lit(0)) != 0)
    banded = ((F.col("area") >= 45) & (F.col("area") < 75)) | F.col("area").between(82.0, 86.5)
    return typed.filter(complete & banded).select(
        "name", F.round("area", 2).alias("area"), "floor", "price",
        F.format_string("%04d-%02d-%02d", "y", "m", "d").alias("date"), "legal_dong", "jibun", "apt_seq",
        whole("build_year").cast("int").alias("build_year"),
    )
