"""Names, parcels, dates, numbers and display texts over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hanok.functions import months as mo
from hanok.functions import parcels as pa
from hanok.functions import places as pl
from hanok.functions import text as tx
from hanok.functions import values as va
from hanok.registry import query
from hanok.starmap import COMPLEX, RAW_SALE

NORM = "regexp_replace(replace(lower({0}), '아파트', ''), '[^0-9a-z가-힣]', '', 'g')"


@query("name_norm", "P1", f"""SELECT doc_id, length({NORM.format('text')}) AS n, md5({NORM.format('text')}) AS digest FROM documents""")
def name_norm(star):
    n = tx.norm("text")
    return star.table("documents").select("doc_id", F.length(n).cast("bigint").alias("n"), F.md5(n).alias("digest"))


NAMES = """names AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '(' || p_size || '-' || p_partkey || ')'
   WHEN 1 THEN p_name || ' (' || p_type || ')아파트' WHEN 2 THEN upper(p_name) || ' APT ' || p_size || '차' ELSE '한솔' || p_size || '단지 ' || p_brand END AS name FROM part)"""
STRIP = "regexp_replace(replace(replace({0}, '아파트', ''), 'apt', ''), '[^0-9a-z가-힣]', '', 'g')"


def _names(star):
    k = F.col("p_partkey") % 4
    name = (
        F.when(k == 0, F.concat(F.lit("("), F.col("p_size"), F.lit("-"), F.col("p_partkey"), F.lit(")")))
        .when(k == 1, F.concat("p_name", F.lit(" ("), "p_type", F.lit(")아파트")))
        .when(k == 2, F.concat(F.upper("p_name"), F.lit(" APT "), F.col("p_size"), F.lit("차")))
        .otherwise(F.concat(F.lit("한솔"), F.col("p_size"), F.lit("단지 "), F.col("p_brand")))
    )
    return star.table("part").select("p_partkey", name.alias("name"))


@query("name_norm_brackets", "P2", f"""WITH {NAMES} SELECT p_partkey,
  coalesce(nullif({STRIP.format("regexp_replace(lower(name), '\\([^)]*\\)', '', 'g')")}, ''), {STRIP.format('lower(name)')}) AS name FROM names""")
def name_norm_brackets(star):
    return _names(star).select("p_partkey", tx.norm_name("name").alias("name"))


@query("station_names", "P3", r"""SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name || ' (' || c_mktsegment || ') 역', '\([^)]*\)', '', 'g'), '\s', '', 'g'), '역$', '') AS station FROM customer""")
def station_names(star):
    raw = F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(") 역"))
    return star.table("customer").select("c_custkey", tx.station_name(raw).alias("station"))


@query("line_labels", "P4", """WITH n AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '서울 지하철 ' || (c_custkey % 9 + 1) || '호선 김포공항 - ' || c_mktsegment
  WHEN 1 THEN '신분당선' WHEN 2 THEN '수인분당선' WHEN 3 THEN 'Line ' || (c_custkey % 9 + 1) || ' ' || c_name WHEN 4 THEN '공항철도 서울역'
  WHEN 5 THEN 'GTX-A ' || c_mktsegment ELSE c_mktsegment END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'subway' ELSE 'train' END AS route, CAST(c_custkey % 11 AS VARCHAR) AS ref FROM customer)
SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN concat_ws(',', least(d, r), CASE WHEN r <> d THEN greatest(d, r) END)
   WHEN 1 THEN concat_ws(',', r, '신분당') WHEN 2 THEN concat_ws(',', r, '수인분당') WHEN 3 THEN concat_ws(',', least(d, r), CASE WHEN r <> d THEN greatest(d, r) END)
   WHEN 4 THEN concat_ws(',', r, '공항') WHEN 5 THEN concat_ws(',', r, 'GTX-A') ELSE coalesce(r, '') END AS lines
FROM (SELECT *, CAST(c_custkey % 9 + 1 AS VARCHAR) AS d, CASE WHEN route = 'subway' AND ref BETWEEN '1' AND '9' AND length(ref) = 1 THEN ref END AS r FROM n)""")
def line_labels(star):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    number = (k % 9 + 1).cast("string")
    name = (
        F.when(k % 7 == 0, F.concat(F.lit("서울 지하철 "), number, F.lit("호선 김포공항 - "), seg))
        .when(k % 7 == 1, "신분당선").when(k % 7 == 2, "수인분당선")
        .when(k % 7 == 3, F.concat(F.lit("Line "), number, F.lit(" "), F.col("c_name")))
        .when(k % 7 == 4, "공항철도 서울역").when(k % 7 == 5, F.concat(F.lit("GTX-A "), seg)).otherwise(seg)
    )
    tags = F.create_map(
        F.lit("name"), name, F.lit("route"), F.when(k % 2 == 0, "subway").otherwise("train"), F.lit("ref"), (k % 11).cast("string")
    )
    return star.table("customer").select("c_custkey", F.concat_ws(",", pl.line_labels(tags)).alias("lines"))


@query("sale_parcels", "P5", f"""WITH {RAW_SALE} SELECT stdg_nm, CASE WHEN sno = 0 THEN '' || mno ELSE mno || '-' || sno END AS parcel, count(*) AS n FROM raw_sale GROUP BY 1, 2""")
def sale_parcels(star):
    return star.raw_sales().groupBy("stdg_nm", pa.parcel("mno", "sno").alias("parcel")).agg(F.count("*").alias("n"))


ADDRESS = """a AS (SELECT c_custkey, n_name AS region, '당산동' AS dong,
  CASE c_custkey % 5 WHEN 0 THEN (c_custkey % 300) || '-2번지 ' || c_mktsegment WHEN 1 THEN '' || (c_custkey % 900 + 1) WHEN 2 THEN '당산동 ' || (c_custkey % 90 + 1) || '-1'
    WHEN 3 THEN c_name ELSE '' END AS detail,
  CASE c_custkey % 3 WHEN 0 THEN '서울특별시 ' || n_name || ' 당산동 ' || (c_custkey % 900 + 1) || ' ' || c_mktsegment WHEN 1 THEN '서울특별시 ' || n_name || ' 당산동 산 ' || (c_custkey % 90 + 1) || '-1'
    ELSE '서울특별시 당산동 7' END AS address
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def _addresses(star):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    c = star.table("customer").join(star.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))

    def s(e):
        return e.cast("string")

    detail = (
        F.when(k % 5 == 0, F.concat(s(k % 300), F.lit("-2번지 "), seg)).when(k % 5 == 1, s(k % 900 + 1))
        .when(k % 5 == 2, F.concat(F.lit("당산동 "), s(k % 90 + 1), F.lit("-1"))).when(k % 5 == 3, F.col("c_name")).otherwise("")
    )
    city = F.concat(F.lit("서울특별시 "), F.col("n_name"))
    address = (
        F.when(k % 3 == 0, F.concat(city, F.lit(" 당산동 "), s(k % 900 + 1), F.lit(" "), seg))
        .when(k % 3 == 1, F.concat(city, F.lit(" 당산동 산 "), s(k % 90 + 1), F.lit("-1"))).otherwise("서울특별시 당산동 7")
    )
    return c.select("c_custkey", F.col("n_name").alias("region"), F.lit("당산동").alias("dong"), detail.alias("detail"), address.alias("address"))


@query("parcel_evidence", "P6 P7 P8", f"""WITH {ADDRESS}, p AS (SELECT *,
  coalesce(nullif(regexp_extract(detail, '(?:^|[^0-9])([0-9]{{1,4}}(?:-[0-9]{{1,4}})?)\\s*번지(?:\\s|$)', 1), ''), nullif(regexp_extract(detail, '^([0-9]{{1,4}}(?:-[0-9]{{1,4}})?)$', 1), ''),
    regexp_extract(detail, '[가-힣]+동\\s*([0-9]{{1,4}}(?:-[0-9]{{1,4}})?)$', 1)) AS from_detail,
  CASE WHEN contains(address, region) THEN regexp_extract(trim(split_part(address, dong, 2)), '^(?:산\\s*)?([0-9]{{1,4}}(?:-[0-9]{{1,4}})?)(?:\\s|번지|$)', 1) ELSE '' END AS from_address FROM a)
SELECT c_custkey, from_detail, from_address,
  CASE WHEN from_detail <> '' AND from_address <> '' AND from_detail <> from_address THEN 'conflict' WHEN from_detail <> '' AND from_address <> '' THEN 'daddr+stdg_addr'
    WHEN from_detail <> '' THEN 'daddr' WHEN from_address <> '' THEN 'stdg_addr_only_untrusted' ELSE 'none' END AS evidence,
  CASE WHEN from_detail <> '' AND (from_address = '' OR from_address = from_detail) THEN from_detail ELSE '' END AS parcel FROM p""")
def parcel_evidence(star):
    e = pa.parcel_evidence("detail", "address", "region", "dong")
    return _addresses(star).select(
        "c_custkey", pa.parcel_from_detail("detail").alias("from_detail"),
        pa.parcel_from_address("address", "region", "dong").alias("from_address"), e["evidence"].alias("evidence"), e["parcel"].alias("parcel"),
    )


@query("legal_parcels", "P9", """WITH a AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || '읍' ELSE '' END AS eup, p_type || '리' AS dong,
    '경기도 ' || trim(CASE WHEN p_size % 2 = 0 THEN p_brand || '읍' ELSE '' END || ' ' || p_type || '리') || ' ' || CASE WHEN p_size % 3 = 0 THEN '산 ' ELSE '' END || p_size || '-' || (p_partkey % 3) || ' 단지'
    || CASE WHEN p_partkey % 4 = 0 THEN ',경기도 ' || trim(CASE WHEN p_size % 2 = 0 THEN p_brand || '읍' ELSE '' END || ' ' || p_type || '리') || ' ' || (p_size + 1) ELSE '' END AS address FROM part),
 parts AS (SELECT p_partkey, trim(eup || ' ' || dong) AS place, unnest(string_split(address, ',')) AS part FROM a),
 lots AS (SELECT p_partkey, regexp_extract(substr(part, strpos(part, place) + length(place)), '^\\s+(산\\s*)?([0-9]{1,4})(?:-([0-9]{1,4}))?(?:\\s|$)', ['mountain', 'main', 'sub']) AS g FROM parts)
SELECT p_partkey, string_agg(lot, ' ' ORDER BY lot) AS parcels FROM (SELECT DISTINCT p_partkey, CASE WHEN g['mountain'] <> '' THEN '2:' ELSE '1:' END || CAST(try_cast(g['main'] AS INT) AS VARCHAR)
  || CASE WHEN g['sub'] NOT IN ('', '0') THEN '-' || CAST(try_cast(g['sub'] AS INT) AS VARCHAR) ELSE '' END AS lot FROM lots WHERE g['main'] <> '') GROUP BY 1""")
def legal_parcels(star):
    eup = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit("읍"))).otherwise("")
    dong = F.concat("p_type", F.lit("리"))
    place = F.trim(F.concat(eup, F.lit(" "), dong))
    first = F.concat(F.lit("경기도 "), place, F.lit(" "), F.when(F.col("p_size") % 3 == 0, "산 ").otherwise(""), F.col("p_size"), F.lit("-"), F.col("p_partkey") % 3, F.lit(" 단지"))
    more = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(",경기도 "), place, F.lit(" "), F.col("p_size") + 1)).otherwise("")
    df = star.table("part").select("p_partkey", F.concat(first, more).alias("address"), eup.alias("eup"), dong.alias("dong"))
    lots = F.transform(pa.legal_parcels("address", "eup", "dong"), lambda p: F.concat(p["kind"], F.lit(":"), p["parcel"]))
    return df.select("p_partkey", F.concat_ws(" ", F.array_sort(lots)).alias("parcels"))


@query("road_keys", "P10", """SELECT c_custkey, nullif(regexp_extract(a, '([가-힣A-Za-z0-9·]+(?:대로|로|길))\\s+([0-9]+)(?:-([0-9]+))?', 1), '') AS road,
  try_cast(regexp_extract(a, '([가-힣A-Za-z0-9·]+(?:대로|로|길))\\s+([0-9]+)(?:-([0-9]+))?', 2) AS BIGINT) AS main,
  CASE WHEN regexp_matches(a, '([가-힣A-Za-z0-9·]+(?:대로|로|길))\\s+[0-9]+') THEN coalesce(try_cast(regexp_extract(a, '([가-힣A-Za-z0-9·]+(?:대로|로|길))\\s+([0-9]+)(?:-([0-9]+))?', 3) AS BIGINT), 0) END AS sub
FROM (SELECT c_custkey, '서울 ' || c_mktsegment || CASE c_custkey % 4 WHEN 0 THEN '대로 ' WHEN 1 THEN '로 ' WHEN 2 THEN '3길 ' ELSE ' ' END || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '-' || (c_custkey % 7) ELSE '' END AS a FROM customer)""")
def road_keys(star):
    k = F.col("c_custkey")
    kind = F.when(k % 4 == 0, "대로 ").when(k % 4 == 1, "로 ").when(k % 4 == 2, "3길 ").otherwise(" ")
    a = F.concat(F.lit("서울 "), F.col("c_mktsegment"), kind, k, F.when(k % 3 == 0, F.concat(F.lit("-"), k % 7)).otherwise(""))
    r = pa.road_key(a)
    return star.table("customer").select("c_custkey", r["road"].alias("road"), r["main"].cast("bigint").alias("main"), r["sub"].cast("bigint").alias("sub"))


@query("pnu_identity", "P11", """WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 9 THEN '41' || c_custkey ELSE '41' || lpad('' || c_nationkey, 3, '0') || lpad('' || (c_custkey % 400), 5, '0') || (c_custkey % 2 + 1)
    || lpad('' || (c_custkey % 1500), 4, '0') || lpad('' || (c_custkey % 3), 4, '0') END AS pnu, CASE WHEN c_custkey % 8 = 7 THEN '' ELSE '' || (1980 + c_nationkey) || '05' END AS moved FROM customer)
SELECT c_custkey, substr(pnu, 1, 5) AS district, substr(pnu, 6, 5) AS dong, substr(pnu, 11, 1) AS kind,
  CAST(substr(pnu, 12, 4) AS INT) || CASE WHEN CAST(substr(pnu, 16, 4) AS INT) > 0 THEN '-' || CAST(substr(pnu, 16, 4) AS INT) ELSE '' END AS parcel, CAST(substr(moved, 1, 4) AS BIGINT) AS year
FROM r WHERE length(pnu) = 19 AND moved <> ''""")
def pnu_identity(star):
    k, n = F.col("c_custkey"), F.col("c_nationkey")

    def pad(e, w):
        return F.lpad(e.cast("string"), w, "0")

    full = F.concat(F.lit("41"), pad(n, 3), pad(k % 400, 5), (k % 2 + 1).cast("string"), pad(k % 1500, 4), pad(k % 3, 4))
    pnu = F.when(k % 10 == 9, F.concat(F.lit("41"), k.cast("string"))).otherwise(full)
    moved = F.when(k % 8 == 7, "").otherwise(F.concat((1980 + n).cast("string"), F.lit("05")))
    df = star.table("customer").select("c_custkey", pa.pnu_identity(pnu, moved).alias("i")).filter("i is not null")
    return df.select("c_custkey", "i.district", "i.dong", "i.kind", "i.parcel", F.col("i.year").cast("bigint").alias("year"))


@query("disclosed_dates", "P12", """SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL WHEN o_orderpriority = '5-LOW' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
  CAST(o_orderpriority = '5-LOW' AS INT) AS bad FROM orders""")
def disclosed_dates(star):
    d, p = F.col("o_orderdate"), F.col("o_orderpriority")
    text = (
        F.when(p == "1-URGENT", F.date_format(d, "MM.dd")).when(p == "2-HIGH", F.date_format(d, "yy.MM.dd"))
        .when(p == "3-MEDIUM", F.date_format(d, "yyyyMMdd")).when(p == "4-NOT SPECIFIED", "").otherwise(F.date_format(d, "'02.30.'yyyy'.1'"))
    )
    # a two-digit year below 100 means this century, so years of the last one are written in full
    text = F.when((p == "2-HIGH") & (F.year(d) < 2000), F.date_format(d, "yyyy.MM.dd")).otherwise(text)
    date = va.disclosed_date("text", "query_year")
    df = star.table("orders").select("o_orderkey", text.alias("text"), F.year("o_orderdate").alias("query_year"))
    return df.select("o_orderkey", date.cast("string").alias("date"), ((tx.clean("text") != "") & date.isNull()).cast("int").alias("bad"))


@query("numbers_from_text", "P13", """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN floor(l_extendedprice) WHEN 'A' THEN l_quantity + 0.5 END AS number,
  CASE l_returnflag WHEN 'N' THEN CAST(floor(l_extendedprice) AS BIGINT) WHEN 'A' THEN CAST(round_even(l_quantity + 0.5, 0) AS BIGINT) END AS whole FROM lineitem""")
def numbers_from_text(star):
    f = F.col("l_returnflag")
    text = F.when(f == "N", F.format_number(F.floor("l_extendedprice"), 0)).when(f == "A", F.concat((F.col("l_quantity") + 0.5).cast("string"), F.lit("%"))).otherwise("nan")
    df = star.table("lineitem").select("l_orderkey", "l_linenumber", text.alias("t"))
    return df.select("l_orderkey", "l_linenumber", va.loose_number("t").alias("number"), va.whole("t").alias("whole"))


@query("completion_months", "P14", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y.%m') WHEN 'O' THEN strftime(o_orderdate + INTERVAL 9 HOUR, '%Y.%m') ELSE strftime(o_orderdate, '%Y') END AS completed FROM orders""")
def completion_months(star):
    s, d = F.col("o_orderstatus"), F.col("o_orderdate")
    millis = F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), d) * 1000
    raw = F.when(s == "F", F.date_format(d, "yyyy-MM-dd")).when(s == "O", millis.cast("string")).otherwise("")
    df = star.table("orders").select("o_orderkey", raw.alias("raw"), F.concat(F.year(d).cast("string"), F.lit("년")).alias("built"))
    return df.select("o_orderkey", va.completed("raw", "built").alias("completed"))


@query("month_arithmetic", "P15 P16", """SELECT event_id, strftime(ts + INTERVAL 9 HOUR - INTERVAL 1 MONTH, '%Y-%m') AS closed, strftime(ts, '%Y-%m') AS ym,
  strftime(date_trunc('month', ts) - INTERVAL 11 MONTH, '%Y-%m') AS shifted, (2026 - year(ts)) * 12 + 10 - month(ts) AS gap,
  (SELECT string_agg(strftime(g, '%Y-%m'), ',' ORDER BY g) FROM (SELECT unnest(generate_series(date_trunc('month', ts), date_trunc('month', ts) + INTERVAL 4 MONTH, INTERVAL 1 MONTH)) AS g)) AS months FROM events""")
def month_arithmetic(star):
    df = star.table("events").select("event_id", "ts", mo.ym_of_date("ts").alias("ym"))
    return df.select(
        "event_id", mo.last_closed_month("ts").alias("closed"), "ym", mo.shift("ym", -11).alias("shifted"),
        mo.month_gap(F.lit("2026-10-01").cast("date"), "ts").cast("bigint").alias("gap"),
        F.concat_ws(",", mo.months_between_inclusive("ym", mo.shift("ym", 4))).alias("months"),
    )


@query("name_keys", "P17 P18", f"""WITH n AS (SELECT p_partkey, '성남시' AS region, '정자동' AS dong, CASE p_partkey % 4 WHEN 0 THEN '정자한솔마을' || p_size || '단지(' || p_name || ')' WHEN 1 THEN '성남 에스케이뷰 ' || p_size || '차'
   WHEN 2 THEN '엘지' || p_name || '아파트' || p_size ELSE 'e편한세상' || p_brand END AS name FROM part),
 b AS (SELECT p_partkey, replace(replace({NORM.format('name')}, '에스케이', 'sk'), '엘지', 'lg') AS s FROM n),
 e AS (SELECT p_partkey, s, regexp_replace(regexp_replace(regexp_replace(replace(s, 'e편한', '이편한'), '^성남', ''), '^정자', ''), '마을', '', 'g') AS t FROM b),
 f AS (SELECT p_partkey, s, regexp_replace(t, '([0-9]+)(?:단지|차)', '\\1', 'g') AS u FROM e)
SELECT p_partkey, regexp_replace(s, '^성남', '') AS canonical, regexp_replace(u, '[0-9]+', '', 'g') || '|' || array_to_string(regexp_extract_all(u, '[0-9]+'), ',') AS name_key FROM f""")
def name_keys(star):
    k = F.col("p_partkey") % 4
    name = (
        F.when(k == 0, F.concat(F.lit("정자한솔마을"), F.col("p_size"), F.lit("단지("), F.col("p_name"), F.lit(")")))
        .when(k == 1, F.concat(F.lit("성남 에스케이뷰 "), F.col("p_size"), F.lit("차")))
        .when(k == 2, F.concat(F.lit("엘지"), F.col("p_name"), F.lit("아파트"), F.col("p_size")))
        .otherwise(F.concat(F.lit("e편한세상"), F.col("p_brand")))
    )
    df = star.table("part").select("p_partkey", name.alias("name"), F.lit("성남시").alias("region"), F.lit("정자동").alias("dong"))
    return df.select("p_partkey", tx.canonical_name("name", "region").alias("canonical"), tx.name_key("name", "region", "dong").alias("name_key"))


@query("region_tags", "P19", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '화성시,동탄구,동탄시' WHEN 1 THEN '성남시,분당구' WHEN 2 THEN '안양시,동안구,평촌동' ELSE '과천시' END AS tags FROM customer""")
def region_tags(star):
    k = F.col("c_custkey") % 4
    df = star.table("customer").select(
        "c_custkey", F.when(k == 0, "화성시").when(k == 1, "성남시").when(k == 2, "안양시").otherwise("과천시").alias("region"),
        F.when(k == 0, "화성동탄구").when(k == 1, "성남분당구").when(k == 2, "안양동안구").otherwise("과천시").alias("district"),
        F.when(k == 2, "평촌동").otherwise("정자동").alias("dong"),
    )
    return df.select("c_custkey", F.concat_ws(",", pl.region_tags("region", "district", "dong")).alias("tags"))


@query("display_texts", "P21 P22 P23", f"""WITH {COMPLEX}, t AS (SELECT complex_id, name, CASE WHEN complex_id % 3 = 0 THEN '' WHEN complex_id % 3 = 1 THEN '2,9당산역' ELSE '마포' END AS station, far * 1000 AS amount, households - 500.25 AS change FROM complex)
SELECT complex_id, CASE WHEN amount IS NULL THEN '—' ELSE regexp_replace(regexp_replace(CAST(CAST(round(CAST(amount AS DECIMAL(20,4)) / 10000.0000, 2) AS DECIMAL(20,2)) AS VARCHAR), '0+$', ''), '\\.$', '') || '억' END AS money,
  CASE WHEN change >= 0 THEN '+' ELSE '' END || CAST(CAST(round(CAST(change AS DECIMAL(20,6)), 1) AS DECIMAL(20,1)) AS VARCHAR) || '%' AS rate,
  CASE WHEN station = '' THEN name ELSE name || '(' || regexp_replace(station, '역$', '') || '역)' END AS shown, 'https://search.example/?sk=' || url_encode(name || ' ' || station) AS url FROM t""")
def display_texts(star):
    k = F.col("complex_id") % 3
    df = star.complexes.withColumn("station", F.when(k == 0, "").when(k == 1, "2,9당산역").otherwise("마포"))
    return df.select(
        "complex_id", va.money(F.col("far") * 1000).alias("money"), va.signed_percent(F.col("households") - 500.25).alias("rate"),
        va.display_name("name", "station").alias("shown"), va.search_url("https://search.example/?sk=", F.concat("name", F.lit(" "), "station")).alias("url"),
    )


@query("tiers", "P25 S10", f"""WITH {COMPLEX} SELECT complex_id, CASE WHEN region = 'NATION_9' AND legal_dong = 'DONG_1' THEN 1 WHEN region IN ('NATION_9', 'NATION_6') THEN 5 WHEN region = 'NATION_11' THEN 7 END AS tier FROM complex""")
def tiers(star):
    # the tier tables are derived from nation, as a configuration would list them
    nations = star.table("nation").select(F.col("n_name").alias("region"))
    by_region = nations.select("region", F.when(F.col("region").isin("NATION_9", "NATION_6"), 5).when(F.col("region") == "NATION_11", 7).alias("tier")).filter("tier is not null")
    by_dong = nations.filter("region = 'NATION_9'").select("region", F.lit("DONG_1").alias("legal_dong"), F.lit(1).alias("tier"))
    return pl.with_tier(star.complexes, by_region, by_dong).select("complex_id", F.col("tier").cast("int").alias("tier"))


@query("year_filter", "P20 F9", f"""WITH {COMPLEX} SELECT complex_id, CAST(substr(completed, 1, 4) AS INT) AS built FROM complex WHERE households BETWEEN 300 AND 1000 AND far BETWEEN 200 AND 800 AND CAST(substr(completed, 1, 4) AS INT) >= 1980""")
def year_filter(star):
    from hanok.operators.estimate import eligible_complexes

    kept = eligible_complexes(star.complexes, households=(300, 1000), far=(200, 800), year=(1980, None))
    return kept.select("complex_id", va.year_of("completed").alias("built"))
