"""Single rules of the jobs, each with rows that break it."""

import pytest
from pyspark.sql import functions as F
from test_portal import ROW, one, responses

from hanok.functions.months import month_index
from hanok.operators import cascade as cs
from hanok.operators import enrich as en
from hanok.operators import guards as g
from hanok.plans import comparison, portal
from hanok.sources import coverage_plan as cp
from hanok.sources import tabular as tb


def master(**change):
    return dict({"apt_cd": "A1", "apt_nm": "가", "sgg_addr": "영등포구", "tnohsh": "300", "cmpx_clsf": "아파트", "hh_type": "분양"}, **change)


def test_official_list_stops_on_missing_and_double_codes_and_odd_households(frame):
    rows = [master(), master(apt_cd="A2", tnohsh="1,200"), master(apt_cd="", apt_nm="나"), master(apt_cd="A3", apt_nm=""), master(apt_cd="A4", tnohsh="nan"),
            master(apt_cd="A5", tnohsh="inf"), master(apt_cd="A6"), master(apt_cd="A6"), master(apt_cd="", sgg_addr="다른구")]
    found = sorted((r.guard, r.key, r.detail) for r in en.master_violations(frame(rows), ["영등포구"]).collect())
    assert found == [
        ("blank_complex_code_or_name", "영등포구", "/나"), ("blank_complex_code_or_name", "영등포구", "A3/"), ("duplicate_complex_code", "A6", "2"),
        ("unknown_households", "A4", "영등포구"), ("unknown_households", "A5", "영등포구"),
    ]
    assert en.master_violations(frame(rows[:2]), ["영등포구"]).isEmpty()


@pytest.mark.parametrize("text, stops", [("nan", True), ("inf", True), ("-Infinity", True), ("many", True), ("", False), ("500", False), ("500.0", False)])
def test_national_list_stops_on_households_that_are_no_numbers(frame, text, stops):
    row = {"시도": "경기도", "시군구": "광명시", "단지코드": "A1", "단지명": "가", "세대수": text}
    assert [r.guard for r in en.national_violations(frame([row]), ["광명시"]).collect()] == ["unreadable_households"] * stops


def test_a_response_only_meets_the_complexes_of_its_request(spark):
    two = one(spark).unionByName(one(spark, complex_id="A2"))  # one dong name, parcel, year and name in two districts of a city
    rows = responses(spark, [ROW, dict(ROW, code="41211", PNU="4121110100103090001", B11="", B21="")])
    plan = spark.createDataFrame([("41210", "10100", "A1"), ("41211", "10100", "A2")], "code string, dong_code string, complex_id string")
    link = lambda p: {(r.code, r.side, r.complex_id) for r in cs.linked_contracts(cs.contracts(rows), two, "2025-09", "2025-09", p).collect()}
    assert {x[2] for x in link(None)} == {None}  # two candidates are none
    assert link(plan) == {("41210", "sale", "A1"), ("41210", "lease", "A1"), ("41211", "sale", "A2")}
    out = portal.collect(two, rows, "2025-09", "2025-09", require_months=False, plan=plan).enforce()
    assert {(r.side, r.reason, r.rows) for r in out.reports["reasons"].collect()} == {("sale", "saved", 2), ("lease", "saved", 1)}
    with pytest.raises(g.GuardError, match="request_without_plan: 41211/10100"):
        portal.collect(two, rows, "2025-09", "2025-09", require_months=False, plan=plan.filter("code = '41210'")).enforce()


def test_reasons_of_contracts(spark):
    rows = [ROW, ROW, dict(ROW, DPOS_GBN="25.12.12"), dict(ROW, KAB_APTNM="모르는 집", B11=""), dict(ROW, A31="", B11=""), dict(ROW, BLDG_MUSE_CD="1")]
    contracts = cs.contracts(responses(spark, rows))
    linked = cs.linked_contracts(contracts, one(spark), "2025-09", "2025-09")
    got = {(r.side, r.reason): r.rows for r in cs.reason_counts(contracts, linked).collect()}
    assert got == {
        ("sale", "saved"): 1, ("sale", "duplicate_disclosed"): 1, ("sale", "cancelled_sale"): 1, ("sale", "unmatched"): 1, ("sale", "missing_sale_floor"): 1,
        ("sale", "other_use"): 1, ("lease", "saved"): 1, ("lease", "duplicate_disclosed"): 2, ("lease", "other_use"): 1,
    }


def test_requests_of_an_eup_carry_all_its_complexes(spark):
    catalogue = spark.createDataFrame([("A", "화성시", "화성시", "봉담읍 상리"), ("B", "화성시", "화성시", "봉담읍 하리"), ("C", "화성시", "화성시", "병점동")], "complex_id string, region string, district string, legal_dong string")
    dongs = spark.createDataFrame([("41590", "화성시", "25321", "봉담읍 상리"), ("41590", "화성시", "25322", "봉담읍 하리"), ("41590", "화성시", "10100", "병점동")], "code string, district_name string, dong_code string, dong_name string")
    got = {(r.code, r.dong_code, r.complex_id) for r in cp.plan_requests(catalogue, dongs).collect()}
    assert got == {("41590", "25321", "A"), ("41590", "25321", "B"), ("41590", "10100", "C")}
    assert {(r.code, r.dong_code) for r in cp.coverage_plan(catalogue, dongs).collect()} == {x[:2] for x in got}


def test_metadata_without_ids_is_named_by_position(frame):
    rows = [{"자치구": "서울 동작구", "아파트명": f"집{i}", "주소": f"길 {i}", "단지코드": "A7" if i == 1 else "", "n": i} for i in range(3)] + [{"자치구": "마포구", "아파트명": "집", "주소": "길", "n": 9}]
    got = tb.catalog_table(frame(rows), ["동작구", "마포구"], order="n", codes={"동작구": "11590", "마포구": "11440"})
    assert {r.name + r.region: r.complex_id for r in got.collect()} == {"집0동작구": "11590-meta-1", "집1동작구": "A7", "집2동작구": "11590-meta-3", "집마포구": "11440-meta-1"}
    assert {(r.key, r.detail) for r in tb.catalog_violations(got, ["동작구", "마포구", "성동구"], 3).collect()} == {("마포구", "1"), ("성동구", "0")}


def test_third_name_of_the_trade_sequence(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><item><아파트>집</아파트><아파트일련번호>77</아파트일련번호></item><item><aptNm>집</aptNm><단지일련번호> </단지일련번호><아파트일련번호>78</아파트일련번호></item></r>", encoding="utf-8")
    assert sorted((r.name, r.apt_seq) for r in tb.read_items(spark, str(tmp_path)).collect()) == [("집", "77"), ("집", "78")]


def test_a_month_that_is_yet_to_come_has_no_comparison(spark):
    c = spark.createDataFrame([("A1", "집", "r", "동", 500, None, 2000, "2000.01")], "complex_id string, name string, region string, legal_dong string, households int, far double, build_year int, completed string")
    sales = spark.createDataFrame([("A1", "2026-09-01", "2026-09", 59.9, 3, 50000)], "complex_id string, date string, ym string, area double, floor int, price bigint")
    sales = sales.withColumn("date", sales.date.cast("date")).withColumn("midx", F.lit(month_index("2026-09")))
    meta = spark.createDataFrame([("city", "2026-09"), ("province", "2026-10")], "provider string, current_month string")
    count = lambda to: comparison.compare(c, sales, "2026-08", to, meta=meta).count()
    assert (count("2026-09"), count("2026-10")) == (1, 0)


def test_sale_reasons_count_linked_rows_once(spark):
    from hanok.operators import linking as ln

    rows = spark.createDataFrame([("non_apartment",), ("non_apartment",), (None,)], "excluded string")
    linked = spark.createDataFrame([("saved", "exact_name"), ("saved", "binding"), ("cancelled", "exact_name"), ("unmatched", None)], "outcome string, method string")
    out = ln.reason_counts(rows, linked)
    assert sorted((r.reason, r.rows) for r in out.collect()) == [("cancelled", 1), ("linked_by_exact_name", 2), ("non_apartment", 2), ("saved", 2), ("unmatched", 1)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # rows and linked, each read once
    none = ln.reason_counts(rows, linked.limit(0))
    assert sorted((r.reason, r.rows) for r in none.collect()) == [("linked_by_exact_name", 0), ("non_apartment", 2)]


def test_item_values_are_computed_once(spark):
    from hanok.sources import tabular as tb

    items = spark.createDataFrame([{f: "" for f in tb.ITEM_NAMES} | dict(name="a", area="59.9", floor="3", price="1,000", year="2025", month="9", day="1", build_year="2000")])
    out = tb.item_trades(items)
    assert [(r.area, r.floor, r.price, r.date, r.build_year) for r in out.collect()] == [(59.9, 3, 1000, "2025-09-01", 2000)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1 and "try_cast" not in plan.split("+- Project")[-1]  # no filter below parses numbers again


def test_item_texts_are_parsed_once(spark, tmp_path):
    from hanok.functions.text import first_nonblank

    (tmp_path / "a.xml").write_text(
        "<r><item><아파트>가</아파트><전용면적> 59.90% </전용면적><층>-1</층><거래금액> 1,000.5</거래금액><년>2025</년><월>9.5</월><일>1</일></item>"
        "<item><aptNm>나</aptNm><excluUseAr>59.9d</excluUseAr><floor>1</floor><dealAmount>1</dealAmount><dealYear>2025</dealYear><dealMonth>9</dealMonth><dealDay>1</dealDay></item>"
        "<item><aptNm>다</aptNm><excluUseAr>60</excluUseAr><floor>Infinity</floor><dealAmount>1</dealAmount><dealYear>2025</dealYear><dealMonth>9</dealMonth><dealDay>1</dealDay></item>"
        "<item><aptNm>nan</aptNm><아파트>라</아파트><excluUseAr>\u00a084\u3000</excluUseAr><floor>2</floor><dealAmount>7</dealAmount><dealYear>2025</dealYear><dealMonth>9</dealMonth><dealDay>1</dealDay></item></r>",
        encoding="utf-8",
    )
    out = tb.item_trades(tb.read_items(spark, str(tmp_path))).drop("build_year")
    assert sorted((r.name, r.area, r.floor, r.price, r.date) for r in out.collect()) == [("가", 59.9, -1, 1000, "2025-10-01"), ("라", 84.0, 2, 7, "2025-09-01")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_cast") == 6  # one for each number
    assert plan.count("trim(excluUseAr") == 1 and plan.count("trim(전용면적") == 1
    texts = spark.createDataFrame([(" a ", "a"), ("nan", " None"), (None, "\u3000b"), ("", None)], "x string, y string")
    assert [tuple(r) for r in texts.select(first_nonblank("x", "y"), first_nonblank("y"), first_nonblank()).collect()] == [("a", "a", ""), ("", "", ""), ("b", "b", ""), ("", "", "")]


def test_folded_equals_the_long_way(spark):
    from hanok.functions.months import let
    from hanok.functions.text import compat, composed, folded

    texts = ["a B#1", "당산 아파트", "ⅣＡ㈜", "\u1103\u1161\u11bc", "①차", "é", "\U0001d400", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(folded("t").alias("a"), let(composed("t"), compat).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
