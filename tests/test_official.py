import datetime as dt

import pytest
from pyspark.sql import functions as F

from hanok.operators import enrich as en
from hanok.operators import guards as g
from hanok.operators import ledger as lg
from hanok.operators import linking as ln
from hanok.plans import official as off
from hanok.sources import lookups

CATALOG = "complex_id string, name string, official_name string, region string, households int, legal_dong string, build_year int, metadata_jibun string, aliases array<string>"
BINDING = "complex_id string, legal_dong string, jibun string, trade_name string, build_year int"
SALE = {
    "cgg_cd": "11560", "rcpt_yr": "2026", "bldg_usg": "아파트", "rght_se": None, "ctrt_day": "20260910", "stdg_nm": "당산동", "mno": "0001", "sno": "0000",
    "bldg_nm": "검증단지", "arch_yr": "2000", "thing_amt": "100,000", "arch_area": "59.9", "flr": "5", "rtrcn_day": None,
}
LEASE = {
    "cgg_cd": "11560", "bldg_usg": "아파트", "rent_se": "전세", "rtfe": "0", "ctrt_day": "20260915", "stdg_nm": "당산동", "mno": "0001", "sno": "0000", "bldg_nm": "검증단지아파트",
    "arch_yr": "2000", "rent_area": "59.9", "grfe": "70000", "flr": "5", "new_updt_yn": "신규", "ctrt_prd": "26.09~28.09", "ctrt_updt_use_yn": "", "bfr_grfe": None, "bfr_rtfe": None,
}


@pytest.fixture
def world(spark, frame):
    class World:
        catalog = spark.createDataFrame([("A1", "검증단지", "검증단지", "영등포구", 300, "당산동", 2000, "1", [])], CATALOG)
        bindings = spark.createDataFrame([], BINDING)
        districts = lookups.region_codes(spark, [{"code": "11560", "name": "영등포구"}])

        def sales(self, rows, stored=None, start="2026-09", end="2026-09", effective=None):
            return off.collect_sales(self.catalog, frame(rows), self.bindings, self.districts, start, end, stored, effective)

    return World()


def copies(n=100, **change):
    return [dict(SALE, **change) for _ in range(n)]


def test_equal_trades_of_a_day_all_stay(world):
    out = world.sales(copies()).enforce()
    assert out.tables["sales"].count() == 100
    again = world.sales(copies(), out.tables["sales"]).enforce()
    assert again.tables["sales"].count() == 100
    assert out.tables["complexes"].first().data_status == "collected"


def test_cancelled_and_rights_are_left_out(world):
    rows = copies(97) + [dict(SALE, rtrcn_day="20261001"), dict(SALE, rght_se="분양권"), dict(SALE, rght_se="입주권"), dict(SALE, bldg_usg="오피스텔")]
    out = world.sales(rows).enforce()
    assert out.tables["sales"].count() == 97
    reasons = {r.reason: r.rows for r in out.reports["reasons"].collect()}
    assert reasons == {"rights_excluded": 2, "non_apartment": 1, "cancelled": 1, "saved": 97, "linked_by_exact_name": 98}


def test_all_cancelled_is_linked_without_active_trades(world):
    rows = copies(rtrcn_day="20261001")
    assert world.sales(rows).tables["complexes"].first().data_status == "no_active_trades"


def test_changed_names_stop_publishing(world):
    stored = world.sales(copies()).tables["sales"]
    rows = copies(10) + copies(90, bldg_nm="동명이인후보")
    with pytest.raises(g.GuardError, match="trades_collapsed"):
        world.sales(rows, stored).enforce()


def test_wrong_dong_is_never_linked(world):
    with pytest.raises(g.GuardError, match="nothing_linked"):
        world.sales(copies(stdg_nm="대림동")).enforce()


def test_missing_month_and_other_district_stop(world):
    with pytest.raises(g.GuardError, match="missing_month"):
        world.sales(copies(), start="2026-08").enforce()
    with pytest.raises(g.GuardError, match="outside_district"):
        world.sales(copies() + [dict(SALE, cgg_cd="11440")]).enforce()


def test_short_response_and_bad_values_stop(world):
    with pytest.raises(g.GuardError, match="too_few_rows"):
        world.sales(copies(99)).enforce()
    with pytest.raises(g.GuardError, match="bad_sale_date"):
        world.sales(copies() + [dict(SALE, ctrt_day="20261345")]).enforce()
    with pytest.raises(g.GuardError, match="invalid_sale"):
        world.sales(copies() + [dict(SALE, flr="x")]).enforce()
    with pytest.raises(g.GuardError, match="bad_sale_key"):
        world.sales(copies() + [dict(SALE, mno="x")]).enforce()


def test_older_history_is_frozen(world, spark, frame):
    old = spark.createDataFrame(
        [("A1", dt.date(2025, 1, 10), "2025-01", 59.9, 5, 90000, "당산동", "1"), ("A1", dt.date(2024, 1, 10), "2024-01", 59.9, 5, 90000, "당산동", "1")],
        "complex_id string, date date, ym string, area double, floor int, price bigint, legal_dong string, parcel string",
    )
    rows = [dict(SALE, ctrt_day=f"2026{m:02}10") for m in range(1, 10) for _ in range(100)]
    start = ln.effective_start(ln.sale_rows(frame(copies(1)), world.districts), "2025-01").first()
    assert start.effective_start == "2026-01"
    out = world.sales(rows, old, start="2025-01", effective="2026-01").enforce()
    assert out.tables["sales"].count() == 901


def test_same_key_in_three_districts_never_merges(spark, frame):
    specs = [("11560", "영등포구"), ("11200", "성동구"), ("11440", "마포구")]
    catalog = spark.createDataFrame([(c, "검증단지", "검증단지", n, 300, "같은동", 2000, "1", []) for c, n in specs], CATALOG)
    bindings = spark.createDataFrame([(c, "같은동", "1", "검증단지", 2000) for c, _ in specs], BINDING)
    districts = lookups.region_codes(spark, [{"code": c, "name": n} for c, n in specs])
    rows = [dict(SALE, cgg_cd=c, stdg_nm="같은동", thing_amt=str(100000 + i * 10000)) for i, (c, _) in enumerate(specs) for _ in range(100)]
    out = off.collect_sales(catalog, frame(rows), bindings, districts, "2026-09", "2026-09").enforce()
    got = {r.complex_id: (r.n, r.p) for r in out.tables["sales"].groupBy("complex_id").agg(F.count("*").alias("n"), F.max("price").alias("p")).collect()}
    assert got == {"11560": (100, 100000), "11200": (100, 110000), "11440": (100, 120000)}
    with pytest.raises(g.GuardError, match="missing_month: 마포구"):
        off.collect_sales(catalog, frame(rows[:200]), bindings, districts, "2026-09", "2026-09").enforce()


def test_matching_keys_equals_matching_rows(spark, frame, world):
    rows = ln.sale_rows(frame(copies(30) + copies(5, bldg_nm="다른") + copies(5, mno="2")), world.districts)
    small = ln.link(rows, world.bindings, world.catalog)
    large = ln.resolve(rows, world.bindings, world.catalog)
    key = ["trade_name", "parcel", "complex_id", "method"]
    count = lambda df: {tuple(r) for r in df.groupBy(*key).count().collect()}
    assert count(small) == count(large) and len(count(small)) == 3


def test_binding_conflicts(spark, world):
    good = spark.createDataFrame([("A1", "당산동", "1", "검증", 2001)], BINDING)
    assert ln.binding_conflicts(good, world.catalog).isEmpty()
    bad = spark.createDataFrame([("A1", "당산동", "1", "검증", 2003), ("A1", "대림동", "1", "검증", 2000)], BINDING)
    assert ln.binding_conflicts(bad, world.catalog).count() == 2


def lease_tables(spark, frame, rows, start="2026-01", end="2026-09"):
    catalog = spark.createDataFrame([("A1", "검증단지아파트", "검증단지아파트", "영등포구", 500, "당산동", 2000, "1", [])], CATALOG)
    bindings = spark.createDataFrame([("A1", "당산동", "1", "검증단지아파트", 2000)], BINDING)
    typed = ln.lease_rows(frame(rows), lookups.region_codes(spark, [{"code": "11560", "name": "영등포구"}]))
    linked = ln.linked_leases(typed, bindings, catalog, start, end)
    return typed, linked, ln.distinct_leases(linked)


def test_lease_copies_are_one_contract_but_periods_differ(spark, frame):
    _, linked, kept = lease_tables(spark, frame, [LEASE, dict(LEASE), dict(LEASE, ctrt_prd="26.10~28.10")])
    assert linked.count() == 3 and kept.count() == 2


def test_lease_matching_and_monthly_rent(spark, frame):
    rows = [LEASE, dict(LEASE, rtfe="10"), dict(LEASE, rent_se="월세"), dict(LEASE, stdg_nm="양평동"), dict(LEASE, mno="2"), dict(LEASE, arch_yr="2020")]
    _, linked, kept = lease_tables(spark, frame, rows)
    assert kept.count() == 1 and linked.filter("outcome = 'unmatched'").count() == 3


def test_unknown_lease_floor_stays_unknown_and_labels_are_kept(spark, frame):
    _, _, kept = lease_tables(spark, frame, [dict(LEASE, flr=None, new_updt_yn="갱신", ctrt_updt_use_yn="○"), dict(LEASE, new_updt_yn="")])
    got = {(r.floor, r.kind, r.right_used) for r in kept.collect()}
    assert got == {(None, "갱신", "○"), (5, "미상", "")}


def test_unreadable_rent_stops(spark, frame):
    rows, linked, _ = lease_tables(spark, frame, [dict(LEASE, rtfe="?"), dict(LEASE, grfe="0"), LEASE])
    found = {r.guard for r in ln.lease_guards(linked, rows).collect()}
    assert found == {"rent_unreadable", "invalid_lease"}


LEDGER = {
    "sgg_cd_nm": "서울특별시 영등포구", "stdg_cd_nm": "당산동", "mn_lotno": "1", "sub_lotno": "0", "na_road_cd_nm": "검증로", "na_mn_lotno": "10", "na_sub_lotno": "0", "hh_cnt": "500",
    "use_aprv_ymd": "2000-01-01", "fart": "300", "siar": "10000", "fart_cmpttn_gfa": "30000", "mn_usg_cd_nm": "공동주택", "etc_usg_cn": None, "bdrg_sn": "100000000000000000001", "plat_plc": "당산동 1",
}


@pytest.mark.parametrize(
    "rows, far, reason",
    [
        ([LEDGER], 300.0, "주소·세대수 일치 총괄표제부"),
        ([dict(LEDGER, mn_lotno="9")], 300.0, "주소·세대수 일치 총괄표제부"),
        ([dict(LEDGER, hh_cnt="900")], None, "대지·세대수 일치 대장 없음"),
        ([dict(LEDGER, hh_cnt="505")], 300.0, "주소·세대수 일치 총괄표제부"),
        ([dict(LEDGER, hh_cnt="506")], None, "대지·세대수 일치 대장 없음"),
        ([dict(LEDGER, use_aprv_ymd="2003-01-01")], None, "대지·세대수 일치 대장 없음"),
        ([dict(LEDGER, use_aprv_ymd="")], 300.0, "주소·세대수 일치 총괄표제부"),
        ([dict(LEDGER, fart="0")], None, "공식 용적률 값 없음 또는 0"),
        ([dict(LEDGER, fart="500")], None, "대장 용적률과 산정면적 비율 불일치"),
        ([dict(LEDGER, fart="302")], 302.0, "주소·세대수 일치 총괄표제부"),
        ([dict(LEDGER, siar="0", fart="500")], 500.0, "주소·세대수 일치 총괄표제부"),
        ([LEDGER, dict(LEDGER, bdrg_sn="2")], None, "동일 단지 대장이 여러 개: 확인 필요"),
        ([LEDGER, dict(LEDGER)], None, "동일 단지 대장이 여러 개: 확인 필요"),
        ([dict(LEDGER, mn_lotno="9", na_main="1", na_mn_lotno="11")], None, "단지와 일치하는 총괄표제부 없음"),
        ([dict(LEDGER, mn_usg_cd_nm="업무시설")], None, "대지·세대수 일치 대장 없음"),
        ([dict(LEDGER, sgg_cd_nm="서울특별시 마포구")], None, "단지와 일치하는 총괄표제부 없음"),
    ],
)
def test_floor_area_ratio(spark, frame, rows, far, reason):
    c = spark.createDataFrame(
        [("A1", "당산동", 2000, 500, "서울특별시 영등포구 검증로 10", "서울특별시 영등포구")],
        "complex_id string, legal_dong string, build_year int, households int, address string, region_name string",
    )
    b = spark.createDataFrame([("A1", "당산동", "1", "검증", 2000)], BINDING)
    r = lg.assign_ratio(c, b, lg.ledger_rows(frame(rows))).first()
    assert (r.far, r.far_reason) == (far, reason)
    if far and rows[0]["bdrg_sn"].startswith("1000"):
        assert r.ledger_id == "100000000000000000001"


def test_official_catalogue_threshold_and_tenure(spark, frame):
    rows = [{"apt_cd": str(i), "apt_nm": str(i), "sgg_addr": "영등포구", "tnohsh": "300", "cmpx_clsf": "아파트", "hh_type": "분양"} for i in range(6)]
    rows[0]["tnohsh"] = "299"
    rows[1]["hh_type"] = "임대"
    rows[2]["tnohsh"] = None
    rows[3].update(sgg_addr="", apt_rdn_addr="서울 영등포구 길 1")
    out, unknown = en.master_catalogue(frame(rows), ["영등포구", "마포구"])
    assert {r.complex_id for r in out.collect()} == {"3", "4", "5"}
    assert [r.complex_id for r in unknown.collect()] == ["2"]
    floors = spark.createDataFrame([("영등포구", 50)], "region string, least int")
    with pytest.raises(g.GuardError, match="catalogue_shrunk"):
        g.enforce(g.shrunk(out.limit(0), out, "region", floors))


def national(**change):
    row = {
        "시도": "경기도", "시군구": "광명시", "읍면": "", "동리": "광명동", "단지코드": "A1", "단지명": "테스트아파트", "단지분류": "아파트", "분양형태": "분양",
        "법정동주소": "경기도 광명시 광명동 309-1 테스트아파트", "도로명주소": "도로 1", "사용승인일": "19980501", "세대수": "500", "최고층수": "25",
    }
    return dict(row, **change)


def test_national_catalogue(frame):
    rows = [
        national(), national(최고층수="26"), national(단지코드="small", 세대수="299"), national(단지코드="rental", 분양형태="임대"),
        national(단지코드="combined", 법정동주소="경기도 광명시 광명동 309-1,경기도 광명시 광명동 310 테스트"),
        national(단지코드="conflict"), national(단지코드="conflict", 세대수="700"), national(단지코드="date", 사용승인일="19981399"),
    ]
    df = frame([dict(r, ord=i) for i, r in enumerate(rows)]).withColumn("ord", F.col("ord").cast("int"))
    good, held = en.national_catalogue(df, ["성남시", "광명시"])
    r = good.collect()
    assert [(x.complex_id, x.top_floor, x.metadata_jibun, x.completed) for x in r] == [("A1", 25, "309-1", "1998.05")]
    assert {x.complex_id for x in held.collect()} == {"combined", "conflict", "date"}


def test_supplement_needs_the_same_households(spark, frame):
    c = spark.createDataFrame([("A1", "강남구", "개포동", 500, 1998, "")], "complex_id string, region string, legal_dong string, households int, build_year int, metadata_jibun string")
    base = dict(national(), 시군구="강남구", 동리="개포동", 법정동주소="서울특별시 강남구 개포동 309-1 테스트")
    got = lambda row: en.supplement_parcels(c, frame([row])).first()
    assert got(dict(base, 세대수="501")).metadata_jibun == ""
    assert got(base).metadata_jibun == "309-1"


def test_feature_fallback(spark):
    c = spark.createDataFrame([("A1",), ("A2",)], "complex_id string")
    prior = spark.createDataFrame([("A1", 300.0)], "complex_id string, far double")
    out, broken = en.fallback_features(c, prior, ["far"], True)
    assert {r.complex_id: r.far for r in out.collect()} == {"A1": 300.0, "A2": None}
    assert [r.key for r in broken.collect()] == ["A2"]
    assert en.fallback_features(c, prior, ["far"], False)[1].count() == 2


def test_small_sources(spark):
    files = spark.createDataFrame([("a", 10), ("b", 1000)], "path string, length bigint")
    assert [r.key for r in g.small_sources(files, 100).collect()] == ["a"]
