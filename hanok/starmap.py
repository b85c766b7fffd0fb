"""Housing-domain views over the star-schema test tables, as DataFrames and as equivalent SQL CTEs.

The library itself never imports this module; only the registered queries and the bench do.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hanok.functions.months import midx_of_date, ym_of_date


class Star:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def complexes(self) -> DataFrame:
        """One complex per supplier."""
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        k = F.col("s_suppkey")
        return (
            s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .select(
                k.alias("complex_id"),
                F.col("s_name").alias("name"),
                F.col("n_name").alias("region"),
                F.col("r_name").alias("province"),
                F.concat(F.lit("DONG_"), (k % 3).cast("string")).alias("legal_dong"),
                (100 + k % 20 * 50).cast("int").alias("households"),
                (1975 + k % 50).cast("int").alias("build_year"),
                F.concat((1975 + k % 50).cast("string"), F.lit("."), F.lpad((k % 12 + 1).cast("string"), 2, "0")).alias("completed"),
                F.when(F.col("s_acctbal") > 0, F.floor("s_acctbal") / 10).alias("far"),
            )
        )

    @cached_property
    def trades(self) -> DataFrame:
        """One disclosed sale per open line item, cancelled ones included."""
        q = F.col("l_quantity")
        return (
            self.table("lineitem")
            .filter(F.col("l_linestatus") == "O")
            .select(
                F.col("l_suppkey").alias("complex_id"),
                F.col("l_shipdate").cast("date").alias("date"),
                ym_of_date(F.col("l_shipdate").cast("date")).alias("ym"),
                midx_of_date(F.col("l_shipdate")).alias("midx"),
                (F.when(q % 2 == 0, 59).otherwise(84) + (q % 6) * 0.25).cast("double").alias("area"),
                (F.col("l_linenumber") * 3).alias("floor"),
                F.floor("l_extendedprice").cast("bigint").alias("price"),
                (F.col("l_returnflag") == "R").alias("cancelled"),
                F.col("l_orderkey").alias("order_key"),
                F.col("l_partkey").alias("part_key"),
            )
        )

    @cached_property
    def sales(self) -> DataFrame:
        return self.trades.filter(~F.col("cancelled")).drop("cancelled")

    @cached_property
    def leases(self) -> DataFrame:
        """One deposit lease per finished line item; the contract kind comes from its order."""
        li, o = self.table("lineitem"), self.table("orders")
        q = F.col("l_quantity")
        kind = F.when(F.col("o_orderstatus") == "F", "신규").when(F.col("o_orderstatus") == "O", "갱신").otherwise("미상")
        return (
            li.filter(F.col("l_linestatus") == "F")
            .join(o, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("l_suppkey").alias("complex_id"),
                F.col("l_shipdate").cast("date").alias("date"),
                ym_of_date(F.col("l_shipdate").cast("date")).alias("ym"),
                midx_of_date(F.col("l_shipdate")).alias("midx"),
                (F.when(q % 2 == 0, 59).otherwise(84) + (q % 6) * 0.25).cast("double").alias("area"),
                F.when(F.col("l_linenumber") < 7, F.col("l_linenumber") * 3).alias("floor"),
                F.floor(F.col("l_extendedprice") * 0.6).cast("bigint").alias("deposit"),
                kind.alias("kind"),
                F.concat(F.col("o_orderpriority"), F.lit("~"), F.date_format("o_orderdate", "yy.MM")).alias("period"),
            )
        )

    def raw_sales(self) -> DataFrame:
        """Disclosed sales as an official export writes them: all text, commas, padded parcels."""
        li, o = self.table("lineitem"), self.table("orders").select("o_orderkey", "o_orderstatus")
        part, c = self.table("part"), self.complexes
        day = F.date_format("l_shipdate", "yyyyMMdd")
        return (
            # the wide columns of the complex come last, so that the other joins move narrow rows
            li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
            .join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
            .join(c, F.col("l_suppkey") == c.complex_id)
            .select(
                F.col("region").alias("cgg_cd"),
                F.year("l_shipdate").cast("string").alias("rcpt_yr"),
                F.when(F.col("o_orderstatus") == "P", "오피스텔").otherwise("아파트").alias("bldg_usg"),
                F.when(F.col("l_linenumber") == 7, "분양권").when(F.col("l_linenumber") > 3, "소유권").alias("rght_se"),
                day.alias("ctrt_day"),
                F.col("legal_dong").alias("stdg_nm"),
                F.lpad((F.col("l_suppkey") % 9 + 1).cast("string"), 4, "0").alias("mno"),
                F.lpad((F.col("l_suppkey") % 4).cast("string"), 4, "0").alias("sno"),
                F.when(F.col("l_tax") > 0.06, F.col("p_name")).otherwise(F.concat(F.col("name"), F.lit(" 아파트"))).alias("bldg_nm"),
                F.col("build_year").cast("string").alias("arch_yr"),
                F.format_number(F.floor("l_extendedprice"), 0).alias("thing_amt"),
                F.col("l_quantity").cast("string").alias("arch_area"),
                F.col("l_linenumber").cast("string").alias("flr"),
                F.when((F.col("l_returnflag") == "R"), day).otherwise("-").alias("rtrcn_day"),
            )
        )


    @cached_property
    def catalogue(self) -> DataFrame:
        """Complexes with the fields that linking reads."""
        k = F.col("complex_id")
        lot = F.concat((k % 9 + 1).cast("string"), F.when(k % 4 > 0, F.concat(F.lit("-"), (k % 4).cast("string"))).otherwise(""))
        return self.complexes.select(
            "*", F.col("name").alias("official_name"), F.array(F.col("name"), F.concat("name", F.lit("(apt)"))).alias("aliases"),
            lot.alias("lot"), F.when(F.col("far").isNotNull(), lot).otherwise("").alias("metadata_jibun"),
            F.concat(F.lit("서울특별시 "), F.col("region"), F.lit(" "), F.replace("legal_dong", F.lit("_"), F.lit("")), F.lit("로 "), k.cast("string")).alias("address"),
        )

    @cached_property
    def districts(self) -> DataFrame:
        return self.table("nation").select(F.col("n_name").alias("cgg_cd"), F.col("n_name").alias("region"))

    @cached_property
    def bindings(self) -> DataFrame:
        """Confirmed keys of the larger complexes."""
        return self.catalogue.filter("households >= 500").select(
            "complex_id", "legal_dong", F.col("lot").alias("jibun"), F.concat("name", F.lit("아파트")).alias("trade_name"), "build_year"
        )

    def raw_leases(self) -> DataFrame:
        """Disclosed leases as an official export writes them; unchanged contracts are disclosed twice."""
        li, o, c = self.table("lineitem"), self.table("orders"), self.complexes
        copies = F.explode(F.sequence(F.lit(1), F.when(F.col("l_returnflag") == "N", 2).otherwise(1)))
        return (
            li.filter("l_linestatus = 'F'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("l_suppkey") == c.complex_id)
            .withColumn("copy", copies)
            .select(
                F.col("region").alias("cgg_cd"), F.lit("아파트").alias("bldg_usg"),
                F.when(F.col("l_linenumber") == 5, "월세").otherwise("전세").alias("rent_se"),
                F.when(F.col("l_linenumber") == 4, "10").otherwise("0").alias("rtfe"),
                F.date_format("l_shipdate", "yyyyMMdd").alias("ctrt_day"), F.col("legal_dong").alias("stdg_nm"),
                F.lpad((F.col("l_suppkey") % 9 + 1).cast("string"), 4, "0").alias("mno"), F.lpad((F.col("l_suppkey") % 4).cast("string"), 4, "0").alias("sno"),
                F.concat("name", F.lit("아파트")).alias("bldg_nm"), F.col("build_year").cast("string").alias("arch_yr"),
                F.col("l_quantity").cast("string").alias("rent_area"), F.format_number(F.floor("l_extendedprice"), 0).alias("grfe"),
                F.when(F.col("l_linenumber") < 7, F.col("l_linenumber").cast("string")).alias("flr"),
                F.when(F.col("o_orderstatus") == "F", "신규").when(F.col("o_orderstatus") == "O", "갱신").otherwise("").alias("new_updt_yn"),
                F.date_format("o_orderdate", "yy.MM").alias("ctrt_prd"), F.when(F.col("o_orderstatus") == "O", "○").otherwise("").alias("ctrt_updt_use_yn"),
                F.lit(None).cast("string").alias("bfr_grfe"), F.lit(None).cast("string").alias("bfr_rtfe"),
            )
        )

    def raw_ledger(self) -> DataFrame:
        """Ledger rows: one per complex with deviations by its attributes, some of them disclosed twice."""
        c, k = self.catalogue, F.col("complex_id")
        copies = F.explode(F.sequence(F.lit(1), F.when(F.col("households") == 700, 2).otherwise(1)))
        return c.withColumn("copy", copies).select(
            F.concat(F.lit("서울특별시 "), "region").alias("sgg_cd_nm"), F.col("legal_dong").alias("stdg_cd_nm"),
            F.when(F.col("households") == 300, F.lit("999")).otherwise((k % 9 + 1).cast("string")).alias("mn_lotno"), (k % 4).cast("string").alias("sub_lotno"),
            F.concat(F.replace("legal_dong", F.lit("_"), F.lit("")), F.lit("로")).alias("na_road_cd_nm"), k.cast("string").alias("na_mn_lotno"), F.lit("0").alias("na_sub_lotno"),
            F.when(F.col("households") == 900, F.col("households") * 2).otherwise(F.col("households") + 3).cast("string").alias("hh_cnt"),
            F.concat(F.col("build_year").cast("string"), F.lit("-01-01")).alias("use_aprv_ymd"),
            F.when(F.col("households") == 400, "0").otherwise(F.coalesce(F.col("far"), F.lit(150.0)).cast("string")).alias("fart"),
            F.lit("10000").alias("siar"),
            (F.coalesce(F.col("far"), F.lit(150.0)) * F.when(F.col("households") == 600, 120).otherwise(100)).cast("string").alias("fart_cmpttn_gfa"),
            F.lit("공동주택").alias("mn_usg_cd_nm"), F.lit(None).cast("string").alias("etc_usg_cn"),
            F.concat(F.lit("1000000000000000"), F.lpad(k.cast("string"), 5, "0")).alias("bdrg_sn"), F.col("address").alias("plat_plc"),
        )

    @cached_property
    def portal_catalogue(self) -> DataFrame:
        return self.catalogue.select(
            "complex_id", "name", "region", "legal_dong", "build_year", "households", F.array("name").alias("aliases"),
            F.when(F.col("households") < 1000, F.array(F.struct(F.lit("1").alias("kind"), F.col("lot").alias("parcel"))))
            .otherwise(F.array().cast("array<struct<kind:string,parcel:string>>")).alias("metadata_parcels"),
        )

    def responses(self) -> DataFrame:
        """Portal rows: a sale and a lease side by side, with the request they answer. Names are spelled in several ways."""
        li, c = self.table("lineitem"), self.complexes
        s, n = self.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_linenumber")
        k = F.col("l_suppkey")

        def pad(e, w):
            return F.lpad(e.cast("string"), w, "0")

        main, sub = F.when(n == 4, F.lit(0)).otherwise(k % 9 + 1), F.when(n == 4, F.lit(0)).otherwise(k % 4)
        code = F.concat(F.lit("41"), pad(F.col("s_nationkey"), 3))
        dong = F.concat(F.lit("10"), pad(k % 3, 3))
        name = (
            F.when(n <= 1, F.concat("name", F.lit("아파트"))).when(n == 2, F.concat(F.lit("the "), "name"))
            .when(n == 3, F.concat(F.replace("name", F.lit("#"), F.lit("마을")), F.lit("차"))).when(n == 4, F.col("name"))
            .when(n == 5, F.substring("name", 1, 12)).otherwise(F.concat(F.lit("다른단지"), k.cast("string")))
        )
        day = F.date_format("l_shipdate", "MM.dd")
        price = F.format_number(F.floor("l_extendedprice"), 0)
        return (
            li.join(c, k == c.complex_id).join(s, k == F.col("s_suppkey"))
            .select(
                code.alias("code"), dong.alias("dong_code"), F.year("l_shipdate").alias("year"), "region",
                F.col("legal_dong").alias("dong"), F.col("legal_dong").alias("canonical_dong"), F.lit(False).alias("eup_scope"), F.lit("").alias("eup_name"),
                F.concat(code, dong, F.lit("1"), pad(main, 4), pad(sub, 4)).alias("PNU"), name.alias("KAB_APTNM"),
                F.col("build_year").cast("string").alias("MVIN_YM"), F.lit("02001").alias("BLDG_MUSE_CD"), F.col("l_quantity").alias("BLDG_AREA"), F.lit("").alias("UMD_NM"),
                day.alias("A11"), F.when(F.col("l_linestatus") == "O", price).alias("A21"), F.when(F.col("l_tax") < 0.08, n.cast("string")).alias("A31"),
                F.when(F.col("l_returnflag") == "R", day).alias("DPOS_GBN"),
                day.alias("B11"), F.when(F.col("l_linestatus") == "F", price).alias("B21"), n.cast("string").alias("B31"), F.lit("1,000(100)").alias("C21"),
            )
        )

COMPLEX = """complex AS (
  SELECT s_suppkey AS complex_id, s_name AS name, n_name AS region, r_name AS province,
    'DONG_' || (s_suppkey % 3) AS legal_dong, 100 + s_suppkey % 20 * 50 AS households,
    1975 + s_suppkey % 50 AS build_year,
    (1975 + s_suppkey % 50) || '.' || lpad(CAST(s_suppkey % 12 + 1 AS VARCHAR), 2, '0') AS completed,
    CASE WHEN s_acctbal > 0 THEN floor(s_acctbal) / 10 END AS far
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

TRADE = """trade AS (
  SELECT l_suppkey AS complex_id, CAST(l_shipdate AS DATE) AS date, strftime(l_shipdate, '%Y-%m') AS ym,
    year(l_shipdate) * 12 + month(l_shipdate) - 1 AS midx,
    CAST(CASE WHEN l_quantity % 2 = 0 THEN 59 ELSE 84 END + (l_quantity % 6) * 0.25 AS DOUBLE) AS area,
    l_linenumber * 3 AS floor, CAST(floor(l_extendedprice) AS BIGINT) AS price, l_returnflag = 'R' AS cancelled,
    l_orderkey AS order_key, l_partkey AS part_key
  FROM lineitem WHERE l_linestatus = 'O')"""

SALE = TRADE + """, sale AS (SELECT * EXCLUDE (cancelled) FROM trade WHERE NOT cancelled)"""

LEASE = """lease AS (
  SELECT l_suppkey AS complex_id, CAST(l_shipdate AS DATE) AS date, strftime(l_shipdate, '%Y-%m') AS ym,
    year(l_shipdate) * 12 + month(l_shipdate) - 1 AS midx,
    CAST(CASE WHEN l_quantity % 2 = 0 THEN 59 ELSE 84 END + (l_quantity % 6) * 0.25 AS DOUBLE) AS area,
    CASE WHEN l_linenumber < 7 THEN l_linenumber * 3 END AS floor,
    CAST(floor(l_extendedprice * 0.6) AS BIGINT) AS deposit,
    CASE o_orderstatus WHEN 'F' THEN '신규' WHEN 'O' THEN '갱신' ELSE '미상' END AS kind,
    o_orderpriority || '~' || strftime(o_orderdate, '%y.%m') AS period
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'F')"""

RAW_SALE = COMPLEX + """, raw_sale AS (
  SELECT region AS cgg_cd, CAST(year(l_shipdate) AS VARCHAR) AS rcpt_yr,
    CASE WHEN o_orderstatus = 'P' THEN '오피스텔' ELSE '아파트' END AS bldg_usg,
    CASE WHEN l_linenumber = 7 THEN '분양권' WHEN l_linenumber > 3 THEN '소유권' END AS rght_se,
    strftime(l_shipdate, '%Y%m%d') AS ctrt_day, legal_dong AS stdg_nm, l_suppkey % 9 + 1 AS mno, l_suppkey % 4 AS sno,
    CASE WHEN l_tax > 0.06 THEN p_name ELSE name || ' 아파트' END AS bldg_nm, build_year AS arch_yr,
    CAST(floor(l_extendedprice) AS BIGINT) AS thing_amt, l_quantity AS arch_area, l_linenumber AS flr,
    CASE WHEN l_returnflag = 'R' THEN strftime(l_shipdate, '%Y%m%d') ELSE '-' END AS rtrcn_day
  FROM lineitem JOIN complex ON l_suppkey = complex_id LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON l_partkey = p_partkey)"""

NORM = "regexp_replace(replace(lower({0}), '아파트', ''), '[^0-9a-z가-힣]', '', 'g')"

CATALOGUE = COMPLEX + """, catalogue AS (SELECT *, (complex_id % 9 + 1) || CASE WHEN complex_id % 4 > 0 THEN '-' || (complex_id % 4) ELSE '' END AS lot,
    CASE WHEN far IS NOT NULL THEN (complex_id % 9 + 1) || CASE WHEN complex_id % 4 > 0 THEN '-' || (complex_id % 4) ELSE '' END ELSE '' END AS metadata_jibun,
    '서울특별시 ' || region || ' ' || replace(legal_dong, '_', '') || '로 ' || complex_id AS address FROM complex)"""

RAW_LEASE = CATALOGUE + """, raw_lease AS (
  SELECT region AS cgg_cd, CASE WHEN l_linenumber = 5 THEN '월세' ELSE '전세' END AS rent_se, CASE WHEN l_linenumber = 4 THEN 10 ELSE 0 END AS rtfe,
    CAST(l_shipdate AS DATE) AS date, strftime(l_shipdate, '%Y-%m') AS ym, l_suppkey, lot, build_year, l_quantity AS area, CAST(floor(l_extendedprice) AS BIGINT) AS deposit,
    CASE WHEN l_linenumber < 7 THEN l_linenumber END AS floor, CASE o_orderstatus WHEN 'F' THEN '신규' WHEN 'O' THEN '갱신' ELSE '미상' END AS kind,
    CASE WHEN o_orderstatus = 'O' THEN '○' ELSE '' END AS right_used, strftime(o_orderdate, '%y.%m') AS period, households, metadata_jibun
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN catalogue ON l_suppkey = complex_id, (VALUES (1), (2)) v(copy)
  WHERE l_linestatus = 'F' AND (copy = 1 OR l_returnflag = 'N'))"""
