"""Linking, cascade, fuzzy match, ledger and catalogue joins over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hanok.operators import cascade as cs
from hanok.operators import enrich as en
from hanok.operators import fuzzy as fz
from hanok.operators import ledger as lg
from hanok.operators import linking as ln
from hanok.registry import query
from hanok.starmap import CATALOGUE, COMPLEX, NORM, RAW_LEASE, RAW_SALE

START, END = "1996-01", "2000-12"

LINKED_SALES = f"""{RAW_SALE}, {CATALOGUE.split(', catalogue AS')[0].replace('complex AS', 'complex_again AS')}, catalogue AS {CATALOGUE.split('catalogue AS ')[1]},
rows_ AS (SELECT *, CASE WHEN bldg_usg <> '아파트' THEN 'non_apartment' WHEN coalesce(rght_se, '') NOT IN ('', '소유권') THEN 'rights_excluded' END AS excluded,
    substr(ctrt_day, 1, 4) || '-' || substr(ctrt_day, 5, 2) AS ym, CASE WHEN sno = 0 THEN '' || mno ELSE mno || '-' || sno END AS parcel, {NORM.format('bldg_nm')} AS trade_name FROM raw_sale),
linked AS (SELECT r.*, c.complex_id, CASE WHEN c.households >= 500 THEN 'binding' WHEN c.complex_id IS NOT NULL THEN 'exact_name' END AS method,
    CASE WHEN c.complex_id IS NULL THEN 'unmatched' WHEN rtrcn_day <> '-' THEN 'cancelled' ELSE 'saved' END AS outcome
  FROM rows_ r LEFT JOIN catalogue c ON r.cgg_cd = c.region AND r.stdg_nm = c.legal_dong AND r.arch_yr = c.build_year AND r.trade_name = {NORM.format('c.name')}
    AND r.parcel = c.lot AND (c.households >= 500 OR c.metadata_jibun = r.parcel)
  WHERE excluded IS NULL AND ym BETWEEN '{START}' AND '{END}')"""


def _linked(star):
    rows = ln.sale_rows(star.raw_sales(), star.districts)
    return rows, ln.linked_sales(rows, star.bindings, star.catalogue, START, END)


@query("linked_sales", "J1 J2 F1 F2 F4 W8 G9", f"""WITH {LINKED_SALES} SELECT complex_id, method, outcome, ym, count(*) AS n, CAST(sum(thing_amt) AS BIGINT) AS total FROM linked GROUP BY 1, 2, 3, 4""")
def linked_sales(star):
    _, linked = _linked(star)
    return linked.groupBy("complex_id", "method", "outcome", "ym").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


@query("reason_counts", "A3", f"""WITH {LINKED_SALES} SELECT excluded AS reason, count(*) AS n FROM rows_ WHERE excluded IS NOT NULL GROUP BY 1
UNION ALL SELECT outcome, count(*) FROM linked GROUP BY 1 UNION ALL SELECT 'linked_by_exact_name', count(*) FROM linked WHERE method = 'exact_name'""")
def reason_counts(star):
    return ln.reason_counts(*_linked(star)).withColumnRenamed("rows", "n")


@query("unmatched_buildings", "A4", f"""WITH {LINKED_SALES} SELECT cgg_cd AS region, stdg_nm AS legal_dong, parcel, bldg_nm AS building, arch_yr AS build_year, count(*) AS n FROM linked WHERE complex_id IS NULL GROUP BY 1, 2, 3, 4, 5""")
def unmatched_buildings(star):
    return ln.unmatched_buildings(_linked(star)[1]).withColumnRenamed("rows", "n")


@query("data_status", "C1", f"""WITH {LINKED_SALES}, seen AS (SELECT complex_id, count(*) FILTER (outcome = 'saved') AS saved FROM linked WHERE complex_id IS NOT NULL GROUP BY 1)
SELECT complex_id, CASE WHEN saved > 0 THEN 'collected' WHEN saved = 0 THEN 'no_active_trades' ELSE 'matching_unconfirmed' END AS data_status FROM complex LEFT JOIN seen USING (complex_id)""")
def data_status(star):
    return ln.data_status(star.catalogue, _linked(star)[1]).select("complex_id", "data_status")


@query("effective_start", "A13", f"""WITH {RAW_SALE} SELECT min(CAST(rcpt_yr AS INT)) AS first_year, greatest('1994-06', min(CAST(rcpt_yr AS INT)) || '-01') AS effective_start FROM raw_sale""")
def effective_start(star):
    return ln.effective_start(ln.sale_rows(star.raw_sales(), star.districts), "1994-06")


@query("linked_leases", "D1 F3 F4 J1", f"""WITH {RAW_LEASE}
SELECT DISTINCT l_suppkey AS complex_id, strftime(date, '%Y-%m-%d') AS date, area, floor, deposit, kind, right_used, period FROM raw_lease
WHERE rent_se = '전세' AND rtfe = 0 AND ym BETWEEN '{START}' AND '{END}' AND households >= 500""")
def linked_leases(star):
    rows = ln.lease_rows(star.raw_leases(), star.districts)
    kept = ln.distinct_leases(ln.linked_leases(rows, star.bindings, star.catalogue, START, END))
    return kept.select("complex_id", F.col("date").cast("string").alias("date"), "area", "floor", "deposit", "kind", "right_used", "period")


@query("lease_status", "C1 F3", f"""WITH {RAW_LEASE} SELECT complex_id, CASE WHEN households >= 500 AND EXISTS (SELECT 1 FROM raw_lease r WHERE r.l_suppkey = complex_id AND rent_se = '전세' AND rtfe = 0
  AND ym BETWEEN '{START}' AND '{END}') THEN 'collected' ELSE 'no_matched_records' END AS jeonse_status FROM catalogue""")
def lease_status(star):
    rows = ln.lease_rows(star.raw_leases(), star.districts)
    kept = ln.distinct_leases(ln.linked_leases(rows, star.bindings, star.catalogue, START, END))
    return ln.lease_status(star.catalogue, kept).select("complex_id", "jeonse_status")


@query("ledger_ratio", "J5 C2 A16", f"""WITH {CATALOGUE} SELECT complex_id,
  CASE WHEN households IN (400, 600, 700, 900) THEN NULL ELSE coalesce(far, 150.0) END AS far, CASE WHEN households IN (400, 600, 700, 900) THEN 'unconfirmed' ELSE 'verified' END AS far_status,
  CASE households WHEN 400 THEN '공식 용적률 값 없음 또는 0' WHEN 600 THEN '대장 용적률과 산정면적 비율 불일치' WHEN 700 THEN '동일 단지 대장이 여러 개: 확인 필요' WHEN 900 THEN '대지·세대수 일치 대장 없음' ELSE '주소·세대수 일치 총괄표제부' END AS far_reason,
  CASE WHEN households NOT IN (700, 900) THEN '1000000000000000' || lpad('' || complex_id, 5, '0') END AS ledger_id FROM catalogue""")
def ledger_ratio(star):
    c = star.catalogue.withColumn("region_name", F.concat(F.lit("서울특별시 "), "region"))
    rated = lg.assign_ratio(c.drop("far"), star.bindings, lg.ledger_rows(star.raw_ledger()))
    return rated.select("complex_id", "far", "far_status", "far_reason", "ledger_id")


PORTAL = f"""{COMPLEX}, side AS (SELECT l.*, c.*, s_nationkey, strftime(l_shipdate, '%Y-%m') AS ym, CASE WHEN l_linestatus = 'O' THEN 'sale' ELSE 'lease' END AS side
    FROM lineitem l JOIN complex c ON l_suppkey = complex_id JOIN supplier ON l_suppkey = s_suppkey WHERE strftime(l_shipdate, '%Y-%m') BETWEEN '{START}' AND '{END}'),
found AS (SELECT *, CASE WHEN l_linenumber <= 1 AND households < 1000 THEN 'parcel_name_year' WHEN l_linenumber = 2 AND households < 1000 THEN 'parcel_name_year'
    WHEN l_linenumber = 3 AND households < 1000 THEN 'parcel_normalized_name_year' WHEN l_linenumber = 5 AND households < 1000 AND {{unique_prefix}} THEN 'parcel_name_year'
    WHEN l_linenumber = 4 THEN 'exact_name_dong_year_missing_parcel' WHEN l_linenumber <= 1 THEN 'exact_name_dong_year_missing_parcel' END AS method FROM side)""".replace(
    "{unique_prefix}",
    "(SELECT count(*) FROM complex o WHERE o.region = side.region AND o.legal_dong = side.legal_dong AND o.build_year = side.build_year AND o.households < 1000 "
    "AND o.complex_id % 9 = side.complex_id % 9 AND o.complex_id % 4 = side.complex_id % 4 AND contains(replace(lower(o.name), '#', ''), replace(lower(substr(side.name, 1, 12)), '#', ''))) = 1",
)


def _contracts(star):
    responses, catalogue = star.responses(), star.portal_catalogue
    rows = cs.contracts(responses, cs.bound(cs.sites_of(responses), catalogue))
    return rows, cs.linked_contracts(rows, catalogue, START, END)


@query("portal_links", "S7 J4 P17 P18 W8", f"""WITH {PORTAL} SELECT CASE WHEN method IS NOT NULL THEN complex_id END AS complex_id, method, side,
  CASE WHEN method IS NULL THEN 'unmatched' WHEN side = 'sale' AND l_returnflag = 'R' THEN 'cancelled_sale' WHEN side = 'sale' AND l_tax >= 0.08 THEN 'missing_sale_floor' ELSE 'saved' END AS outcome,
  count(*) AS n, CAST(sum(floor(l_extendedprice)) AS BIGINT) AS total FROM found GROUP BY 1, 2, 3, 4""")
def portal_links(star):
    linked = _contracts(star)[1]
    return linked.groupBy("complex_id", "method", "side", "outcome").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


@query("portal_contracts", "D2", f"""WITH {PORTAL} SELECT DISTINCT complex_id, side, strftime(l_shipdate, '%Y-%m-%d') AS date, l_quantity AS area,
  l_linenumber AS floor, CAST(floor(l_extendedprice) AS BIGINT) AS price, CASE WHEN side = 'lease' THEN '' WHEN l_linenumber = 4 THEN '0' ELSE (complex_id % 9 + 1) || CASE WHEN complex_id % 4 > 0 THEN '-' || (complex_id % 4) ELSE '' END END AS parcel
FROM found WHERE method IS NOT NULL AND NOT (side = 'sale' AND (l_returnflag = 'R' OR l_tax >= 0.08))""")
def portal_contracts(star):
    saved = cs.distinct_contracts(_contracts(star)[1])
    return saved.select("complex_id", "side", F.col("date").cast("string").alias("date"), "area", "floor", "price", "parcel")


@query("binding_methods", "A14", f"""WITH {PORTAL} SELECT complex_id, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM found WHERE method IS NOT NULL GROUP BY 1""")
def binding_methods(star):
    return cs.binding_methods(_contracts(star)[1]).select("complex_id", F.concat_ws(",", "trade_binding_methods").alias("methods"))


def _part_complexes(star):
    return star.table("part").select(
        F.col("p_partkey").alias("complex_id"), F.col("p_brand").alias("region"), F.col("p_name").alias("name"),
        F.col("p_type").alias("legal_dong"), (F.col("p_size") + 1970).alias("build_year"), F.col("p_partkey").alias("ord"),
    )


@query("fuzzy_equal_names", "J3 W4", """WITH k AS (SELECT DISTINCT p_brand AS region, p_name AS raw_name, CAST(l_quantity AS INT) + 1970 AS build_year, p_type AS legal_dong FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT k.*, p_partkey, 1.0::DOUBLE + CASE WHEN build_year = p_size + 1970 THEN 0.05::DOUBLE WHEN abs(build_year - p_size - 1970) <= 2 THEN 0.02::DOUBLE WHEN abs(build_year - p_size - 1970) >= 7 THEN -0.12::DOUBLE ELSE 0.0 END
    + CASE WHEN legal_dong = p_type THEN 0.04::DOUBLE WHEN NOT contains(p_type, legal_dong) AND NOT contains(legal_dong, p_type) THEN -0.04::DOUBLE ELSE 0.0 END AS score
  FROM k JOIN part ON p_brand = region AND p_name = raw_name)
SELECT region, raw_name, build_year, legal_dong, p_partkey AS complex_id, score FROM (SELECT *, row_number() OVER (PARTITION BY region, raw_name, build_year, legal_dong ORDER BY score DESC, p_partkey) AS n FROM s) WHERE n = 1 AND score >= 0.74""")
def fuzzy_equal_names(star):
    li, p = star.table("lineitem"), star.table("part")
    keys = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("region"), F.col("p_name").alias("raw_name"), (F.col("l_quantity").cast("int") + 1970).alias("build_year"), F.col("p_type").alias("legal_dong")
    ).distinct()
    return fz.best_match(keys, _part_complexes(star))


@query("fuzzy_best_match", "J3")
def fuzzy_best_match(star):
    """Misspelled names: a letter lost, two letters swapped, a word added; checked against brute force in the tests."""
    li, p = star.table("lineitem"), star.table("part")
    name, n = F.col("p_name"), F.col("l_linenumber")
    spelled = (
        F.when(n == 1, F.expr("substring(p_name, 1, length(p_name) - 1)"))
        .when(n == 2, F.concat(F.substring(name, 2, 1), F.substring(name, 1, 1), F.expr("substring(p_name, 3)")))
        .when(n == 3, F.concat(F.lit("the "), name)).when(n == 4, F.concat(name, F.lit("s")))
        .when(n == 5, F.reverse(name)).otherwise(F.concat(name, F.lit(" "), F.col("p_type")))
    )
    keys = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("region"), spelled.alias("raw_name"), (F.col("p_size") + 1970 + n).alias("build_year"), F.col("p_type").alias("legal_dong")
    ).distinct()
    return fz.best_match(keys, _part_complexes(star))


@query("seed_attributes", "J6", f"""WITH {COMPLEX} SELECT complex_id, CASE WHEN s_acctbal > 1000 THEN CAST(1000 + s_suppkey AS INT) ELSE households END AS households,
  CASE WHEN s_acctbal > 3000 THEN 'seed' ELSE legal_dong END AS legal_dong FROM complex JOIN supplier ON complex_id = s_suppkey""")
def seed_attributes(star):
    s = star.table("supplier").join(star.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    seed = s.select(
        F.col("n_name").alias("region"), F.concat("s_name", F.lit(" 아파트")).alias("name"),
        F.when(F.col("s_acctbal") > 1000, (1000 + F.col("s_suppkey")).cast("int")).alias("households"),
        F.when(F.col("s_acctbal") > 3000, "seed").otherwise("").alias("legal_dong"),
    )
    return en.seed_attributes(star.complexes, seed, ["households", "legal_dong"]).select("complex_id", "households", "legal_dong")


@query("excluded_ids", "J7", f"""WITH {COMPLEX} SELECT complex_id FROM complex WHERE far IS NOT NULL""")
def excluded_ids(star):
    return en.exclude(star.complexes, star.complexes.filter("far is null")).select("complex_id")


@query("supplemented_parcels", "J8 P9", f"""WITH {CATALOGUE} SELECT complex_id, CASE WHEN metadata_jibun = '' AND households <> 500 AND complex_id % 7 <> 0 THEN '' || (complex_id + 1) ELSE metadata_jibun END AS metadata_jibun,
  CAST(metadata_jibun = '' AND households <> 500 AND complex_id % 7 <> 0 AS INT) AS supplemented FROM catalogue""")
def supplemented_parcels(star):
    c, k = star.catalogue.withColumn("complex_id", F.col("complex_id").cast("string")), F.col("complex_id").cast("bigint")
    lot = F.when(k % 7 == 0, "산 ").otherwise("")
    national = star.catalogue.select(
        F.col("complex_id").cast("string").alias("단지코드"), F.col("region").alias("시군구"), F.lit("").alias("읍면"), F.col("legal_dong").alias("동리"),
        F.when(F.col("households") == 500, "501").otherwise(F.col("households").cast("string")).alias("세대수"),
        F.concat(F.col("build_year").cast("string"), F.lit("0501")).alias("사용승인일"),
        F.concat(F.lit("서울특별시 "), F.col("region"), F.lit(" "), F.col("legal_dong"), F.lit(" "), lot, (k + 1).cast("string"), F.lit(" 단지")).alias("법정동주소"),
    )
    out = en.supplement_parcels(c, national)
    return out.select(F.col("complex_id").cast("bigint").alias("complex_id"), "metadata_jibun", F.col("supplemented").cast("int").alias("supplemented"))


@query("carried_attributes", "J9 A6", f"""WITH {COMPLEX} SELECT complex_id, CASE WHEN province = 'ASIA' THEN 'station' || complex_id END AS station,
  CASE WHEN province = 'ASIA' THEN name || ',old ' || name ELSE name END AS aliases FROM complex""")
def carried_attributes(star):
    prior = star.complexes.filter("province = 'ASIA'").select(
        "complex_id", F.concat(F.lit("station"), F.col("complex_id").cast("string")).alias("station"), F.array(F.concat(F.lit("old "), F.col("name"))).alias("old")
    )
    out = en.carry_forward(star.complexes, prior, ["station", "old"])
    return out.select("complex_id", "station", F.concat_ws(",", en.aliases_union("old", "name")).alias("aliases"))


@query("fallback_features", "J10", f"""WITH {COMPLEX} SELECT complex_id, CASE WHEN province <> 'EUROPE' THEN far END AS far, CAST(province = 'EUROPE' AS INT) AS unknown FROM complex""")
def fallback_features(star):
    prior = star.complexes.filter("province <> 'EUROPE'")
    out, broken = en.fallback_features(star.complexes, prior, ["far"], prior_enabled=True)
    unknown = broken.select(F.col("key").cast("bigint").alias("complex_id"), F.lit(1).alias("unknown"))
    return out.join(unknown, "complex_id", "left").select("complex_id", "far", F.coalesce("unknown", F.lit(0)).alias("unknown"))


@query("resolved_regions", "J18", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN n_name WHEN c_mktsegment = 'MACHINERY' THEN NULL
  ELSE (SELECT min(o.n_name) FROM nation o WHERE contains('city ' || n.n_name || ' road', o.n_name)) END AS region FROM customer JOIN nation n ON c_nationkey = n.n_nationkey""")
def resolved_regions(star):
    c = star.table("customer").join(star.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    seg = F.col("c_mktsegment")
    df = c.select(
        "c_custkey", F.when(seg == "BUILDING", F.col("n_name")).otherwise("").alias("district"),
        F.when(seg != "MACHINERY", F.concat(F.lit("city "), F.col("n_name"), F.lit(" road"))).alias("address"),
    )
    names = sorted(f"NATION_{i}" for i in range(25))  # the configured list of regions
    return df.select("c_custkey", en.resolve_region(df, names).alias("region"))


@query("official_catalogue", "F6 F7 P14 P8 O2", f"""WITH {CATALOGUE} SELECT '' || complex_id AS complex_id, region, households, build_year, completed, CASE WHEN far IS NOT NULL THEN lot ELSE '' END AS metadata_jibun,
  CASE WHEN far IS NOT NULL THEN 'daddr+stdg_addr' ELSE 'stdg_addr_only_untrusted' END AS evidence FROM catalogue WHERE households >= 300 AND province NOT IN ('AFRICA', 'AMERICA')""")
def official_catalogue(star):
    c = star.catalogue
    rows = c.select(
        F.col("complex_id").cast("string").alias("apt_cd"), F.col("name").alias("apt_nm"), F.col("region").alias("sgg_addr"), F.col("address").alias("apt_rdn_addr"),
        F.format_number(F.col("households"), 0).alias("tnohsh"), F.when(F.col("province") == "AFRICA", "연립").otherwise("아파트").alias("cmpx_clsf"),
        F.when(F.col("province") == "AMERICA", "임대").otherwise("분양").alias("hh_type"), F.col("legal_dong").alias("emd_addr"),
        F.when(F.col("far").isNotNull(), F.concat("lot", F.lit("번지"))).otherwise("").alias("daddr"),
        F.concat(F.lit("서울 "), F.col("region"), F.lit(" "), F.col("legal_dong"), F.lit(" "), F.col("lot")).alias("apt_stdg_addr"),
        F.concat(F.replace("completed", F.lit("."), F.lit("-")), F.lit("-15")).alias("use_aprv_ymd"),
    )
    names = [f"NATION_{i}" for i in range(25)]  # the configured list of regions
    out, _ = en.master_catalogue(rows, names)
    return out.select("complex_id", "region", "households", "build_year", "completed", "metadata_jibun", F.col("metadata_jibun_evidence").alias("evidence"))


def _national_rows(star):
    k, hh = F.col("complex_id"), F.col("households")
    second = F.explode(F.sequence(F.lit(1), F.when(hh.isin(500, 600), 2).otherwise(1)))
    lot = F.concat(F.lit("경기도 "), F.col("region"), F.lit(" "), F.col("legal_dong"), F.lit(" "), F.col("lot"), F.lit(" 단지"))
    more = F.concat(F.lit(",경기도 "), F.col("region"), F.lit(" "), F.col("legal_dong"), F.lit(" 900"))
    return star.catalogue.withColumn("copy", second).select(
        F.when(F.col("province") == "AFRICA", "강원도").otherwise("경기도").alias("시도"), F.concat("region", F.lit("구")).alias("시군구"), F.lit("").alias("읍면"), F.col("legal_dong").alias("동리"),
        k.cast("string").alias("단지코드"), F.when((hh == 500) & (F.col("copy") == 2), F.lit("other")).otherwise(F.col("name")).alias("단지명"), F.lit("아파트").alias("단지분류"),
        F.when(F.col("province") == "ASIA", "임대").otherwise("분양").alias("분양형태"), F.when(hh == 800, F.concat(lot, more)).otherwise(lot).alias("법정동주소"),
        F.lit("도로 1").alias("도로명주소"), F.when(hh == 700, "19801399").otherwise(F.concat(F.col("build_year").cast("string"), F.lit("0501"))).alias("사용승인일"),
        hh.cast("string").alias("세대수"), F.lit("25").alias("최고층수"), (k * 2 + F.col("copy")).alias("ord"),
    )


NATIONAL = f"""{CATALOGUE}, n AS (SELECT *, CASE households WHEN 500 THEN '동일 관리코드 기본정보 충돌' WHEN 700 THEN '사용승인일 확인 필요'
  WHEN 800 THEN '여러 지번/세부 단지 합산 세대수: 각각 300세대 이상인지 확인 필요' END AS reason FROM catalogue WHERE households >= 300 AND province NOT IN ('AFRICA', 'ASIA'))"""


@query("national_catalogue", "A5 F6 F7 G6 W6", f"""WITH {NATIONAL} SELECT '' || complex_id AS complex_id, region, households, build_year, lot AS metadata_jibun, 25 AS top_floor FROM n WHERE reason IS NULL""")
def national_catalogue(star):
    good, _ = en.national_catalogue(_national_rows(star), [f"NATION_{i}" for i in reversed(range(25))])
    return good.select("complex_id", "region", "households", "build_year", "metadata_jibun", "top_floor")


@query("national_violations", "F6 G7", f"""WITH {CATALOGUE}, n AS (SELECT * FROM catalogue WHERE province <> 'AFRICA')
SELECT 'unreadable_households' AS guard, '' || complex_id AS key, '미상' AS detail FROM n WHERE households = 900
UNION ALL SELECT 'blank_complex_code', name, '' FROM n WHERE households = 1000""")
def national_violations(star):
    hh = F.col("세대수")
    rows = _national_rows(star).withColumn("단지코드", F.when(hh == "1000", " ").otherwise(F.col("단지코드"))).withColumn("세대수", F.when(hh == "900", "미상").otherwise(hh))
    return en.national_violations(rows, [f"NATION_{i}" for i in reversed(range(25))])


@query("held_complexes", "C4 A5", f"""WITH {NATIONAL} SELECT '' || complex_id AS complex_id, region, reason FROM n WHERE reason IS NOT NULL""")
def held_complexes(star):
    _, held = en.national_catalogue(_national_rows(star), [f"NATION_{i}" for i in reversed(range(25))])
    return held.select("complex_id", "region", "reason")
