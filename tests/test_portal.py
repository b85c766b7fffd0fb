import datetime as dt

import pytest
from pyspark.sql import functions as F

from hanok.operators import cascade as cs
from hanok.operators import guards as g
from hanok.plans import portal, update
from hanok.plans.official import Outcome

COMPLEX = "complex_id string, name string, region string, legal_dong string, build_year int, households int, aliases array<string>, metadata_parcels array<struct<kind:string,parcel:string>>"
ROW = {
    "code": "41210", "dong_code": "10100", "year": 2025, "region": "광명시", "dong": "광명동", "canonical_dong": "광명동", "eup_scope": False, "eup_name": "",
    "PNU": "4121010100103090001", "UMD_NM": "", "KAB_APTNM": "테스트", "MVIN_YM": "1998", "BLDG_MUSE_CD": "02001", "BLDG_AREA": "59.96",
    "A11": "09.04", "A21": "41,000", "A31": "07", "DPOS_GBN": "", "B11": "09.12", "B21": "30,000", "B31": "09", "C21": "1,000(100)",
}
TYPES = {"year": "int", "eup_scope": "boolean"}


def responses(spark, rows):
    schema = ", ".join(f"{k} {TYPES.get(k, 'string')}" for k in ROW)
    return spark.createDataFrame([tuple(r[k] for k in ROW) for r in rows], schema)


def one(spark, **change):
    c = dict(complex_id="A1", name="테스트", region="광명시", legal_dong="광명동", build_year=1998, households=500, aliases=None, parcels=[("1", "309-1")])
    c.update(change)
    aliases = c["aliases"] or [c["name"]]
    return spark.createDataFrame([(c["complex_id"], c["name"], c["region"], c["legal_dong"], c["build_year"], c["households"], aliases, c["parcels"])], COMPLEX)


def key(spark, name, region, dong, parcel, year):
    df = spark.createDataFrame([(region, dong, "1", parcel, year, name)], "region string, d string, land_kind string, parcel string, build_year int, n string")
    return df.select("region", cs.norm("d").alias("dong"), "land_kind", "parcel", "build_year", cs.norm("n").alias("trade_name"))


def test_cancelled_sale_leaves_the_lease(spark):
    rows = [dict(ROW, DPOS_GBN="25.12.12"), dict(ROW, A21="42,000", B11="", B21=""), dict(ROW, DPOS_GBN="25.12.12")]
    out = portal.collect(one(spark), responses(spark, rows), "2025-09", "2025-09").enforce()
    sale = out.tables["sales"].collect()
    lease = out.tables["leases"].collect()
    assert [(r.price, r.floor) for r in sale] == [(42000, 7)]
    assert [(r.deposit, r.floor, r.kind) for r in lease] == [(30000, 9, "미상")]
    c = out.tables["complexes"].first()
    assert (c.data_status, c.jeonse_status, c.trade_binding_methods) == ("collected", "collected", ["parcel_name_year"])


def test_missing_parcel_needs_the_unique_whole_name(spark):
    c = one(spark, name="과천푸르지오라비엔오", region="과천시", legal_dong="갈현동", build_year=2021, parcels=[])
    ask = lambda cat, name: cs.resolve(key(spark, name, "과천시", "갈현동", "0", 2021), cat).first()
    got = ask(c, "과천푸르지오라비엔오")
    assert (got.complex_id, got.method) == ("A1", "exact_name_dong_year_missing_parcel")
    assert ask(c, "과천푸르지오벨라르테").complex_id is None
    assert ask(c.unionByName(one(spark, complex_id="A2", name="과천푸르지오라비엔오", region="과천시", legal_dong="갈현동", build_year=2021, parcels=[])), "과천푸르지오라비엔오").complex_id is None


def test_different_parcels_never_match_by_name(spark):
    c = one(spark, name="과천푸르지오써밋", region="과천시", legal_dong="별양동", build_year=2020, parcels=[("1", "37")])
    assert cs.resolve(key(spark, "과천푸르지오써밋", "과천시", "별양동", "137", 2020), c).first().complex_id is None


def test_village_names_keep_phase_and_parcel(spark):
    c = one(spark, name="정자한솔마을주공4차", region="성남시", legal_dong="정자동", build_year=1994, parcels=[("1", "102")])
    ask = lambda name, parcel: cs.resolve(key(spark, name, "성남시", "정자동", parcel, 1994), c).first()
    got = ask("한솔마을(4단지)(주공)", "102")
    assert (got.complex_id, got.method) == ("A1", "parcel_normalized_name_year")
    assert ask("한솔마을(5단지)(주공)", "102").complex_id is None
    assert ask("한솔마을(4단지)(주공)", "103").complex_id is None


def test_contained_name_needs_four_letters_and_one_complex(spark):
    c = one(spark, name="한빛푸르지오", parcels=[("1", "7")]).unionByName(one(spark, complex_id="A2", name="힐스", parcels=[("1", "8")]))
    ask = lambda name, parcel, cat=c: cs.resolve(key(spark, name, "광명시", "광명동", parcel, 1998), cat).first().complex_id
    assert ask("푸르지오", "7") == "A1" and ask("새한빛푸르지오2", "7") == "A1"
    assert ask("힐스테이트", "8") is None
    both = c.unionByName(one(spark, complex_id="A3", name="철산푸르지오", parcels=[("1", "7")]))
    assert ask("푸르지오", "7", both) is None and ask("한빛푸르지오", "7", both) == "A1"


def test_disclosed_ri_decides_within_an_eup(spark):
    cat = one(spark, name="테스트단지", region="화성시", legal_dong="남양읍 남양리").unionByName(one(spark, complex_id="A2", name="테스트단지", region="화성시", legal_dong="남양읍 신남리"))
    row = dict(ROW, code="41591", dong_code="25621", region="화성시", dong="남양읍 남양리", canonical_dong="남양읍 남양리", eup_scope=True, eup_name="남양읍",
               PNU="4159125623103090001", UMD_NM="(남양읍 신남리)", KAB_APTNM="테스트단지")
    rows = [row, dict(row, UMD_NM="신남리", A11="09.05"), dict(row, UMD_NM="")]
    out = portal.collect(cat, responses(spark, rows), "2025-09", "2025-09").enforce()
    assert {(r.complex_id, r.legal_dong) for r in out.tables["sales"].collect()} == {("A2", "남양읍 신남리")}
    assert out.tables["sales"].count() == 2


def stored(spark, catalog, sales, leases=()):
    s = "complex_id string, date date, ym string, area double, floor int, price bigint, legal_dong string, parcel string"
    d = "complex_id string, date date, ym string, area double, floor int, deposit bigint, kind string"
    make = lambda day: dt.date.fromisoformat(day)
    return {
        "complexes": catalog,
        "sales": spark.createDataFrame([("A1", make(x), x[:7], 59.96, 7, p, "광명동", "309-1") for x, p in sales], s),
        "leases": spark.createDataFrame([("A1", make(x), x[:7], 59.96, 7, p, "미상") for x, p in leases], d),
    }


MONTH = dict(ROW, year=2026, A11="10.04", B11="10.12")


def test_window_is_replaced_and_history_kept(spark):
    c = one(spark)
    old = stored(spark, c, [("2025-09-09", 39000), ("2026-10-04", 41000)], [("2025-09-09", 28000)])
    rows = [dict(MONTH, DPOS_GBN="2026.11.01"), dict(MONTH, A11="10.06", A21="42000", B11="", B21="")]
    out = portal.collect(c, responses(spark, rows), "2026-10", "2026-10", old, preserve=True).enforce()
    days = lambda t: sorted(str(r.date) for r in t.collect())
    assert days(out.tables["sales"]) == ["2025-09-09", "2026-10-06"]
    assert days(out.tables["leases"]) == ["2025-09-09", "2026-10-12"]
    again = portal.collect(c, responses(spark, rows), "2026-10", "2026-10", dict(out.tables, complexes=c), preserve=True).enforce()
    assert days(again.tables["sales"]) == ["2025-09-09", "2026-10-06"]


def test_history_does_not_hide_a_collapse(spark):
    c = one(spark)
    old = stored(spark, c, [("2024-01-01", 100000)] * 1000 + [("2026-10-01", 100000)] * 10)
    with pytest.raises(g.GuardError, match="trades_collapsed"):
        portal.collect(c, responses(spark, [MONTH]), "2026-10", "2026-10", old, preserve=True).enforce()


def test_empty_month_and_wrong_dong_stop(spark):
    c = one(spark)
    with pytest.raises(g.GuardError, match="missing_month"):
        portal.collect(c, responses(spark, [dict(MONTH, A11="", A21="")]), "2026-10", "2026-10").enforce()
    with pytest.raises(g.GuardError, match="response_mismatch"):
        portal.collect(c, responses(spark, [MONTH, dict(MONTH, PNU="4121010200103090001")]), "2026-10", "2026-10").enforce()
    with pytest.raises(g.GuardError, match="bad_contract_date"):
        portal.collect(c, responses(spark, [MONTH, dict(MONTH, A11="02.30")]), "2026-10", "2026-10").enforce()


def test_new_complex_may_lack_early_months(spark):
    out = portal.collect(one(spark), responses(spark, [MONTH]), "2024-01", "2026-10", require_months=False).enforce()
    assert out.tables["sales"].count() == 1


def test_changed_identity_stops(spark):
    c = one(spark)
    old = stored(spark, one(spark, build_year=2000), [("2024-01-01", 100000)])
    with pytest.raises(g.GuardError, match="identity_conflict"):
        portal.collect(c, responses(spark, [MONTH]), "2026-10", "2026-10", old, preserve=True).enforce()


def test_new_complexes_are_backfilled(spark):
    cat = one(spark).unionByName(one(spark, complex_id="A2", name="새단지", parcels=[("1", "5")]))
    row = dict(MONTH, KAB_APTNM="새단지", PNU="4121010100100050000")
    window = portal.collect(cat, responses(spark, [MONTH, row]), "2026-10", "2026-10", require_months=False)
    older = dict(row, year=2025, A11="03.04", B11="03.05")
    full = portal.collect(cat.filter("complex_id = 'A2'"), responses(spark, [row, older]), "2024-01", "2026-10", require_months=False)
    out = update.backfill(window, full, cat, one(spark)).enforce()
    got = sorted((r.complex_id, r.ym) for r in out.tables["sales"].collect())
    assert got == [("A1", "2026-10"), ("A2", "2025-03"), ("A2", "2026-10")]


def test_providers_are_merged_and_published(spark, tmp_path):
    sales = "complex_id string, date date, ym string, area double, floor int, price bigint"
    leases = "complex_id string, date date, ym string, area double, floor int, deposit bigint, kind string"
    day = dt.date(2026, 10, 1)
    official = Outcome({
        "complexes": spark.createDataFrame([("S1", "영등포구", 300, "collected", "verified", 250.0)], "complex_id string, region string, households int, data_status string, far_status string, far double"),
        "sales": spark.createDataFrame([("S1", day, "2026-10", 59.0, 5, 90000)], sales),
        "leases": spark.createDataFrame([], leases),
    })
    other = Outcome({
        "complexes": spark.createDataFrame([("G1", "광명시", 300, "matching_unconfirmed")], "complex_id string, region string, households int, data_status string"),
        "sales": spark.createDataFrame([], sales),
        "leases": spark.createDataFrame([("G1", day, "2026-10", 59.0, 5, 30000, "미상")], leases),
    })
    merged = update.merge(official, other)
    merged.tables["complexes"] = merged.tables["complexes"].fillna("unconfirmed", ["far_status"])
    cover = {r.region: (r.complexes, r.sale_rows, r.lease_rows, r.unresolved) for r in merged.reports["coverage"].collect()}
    assert cover == {None: (2, 1, 1, 1), "영등포구": (1, 1, 0, 0), "광명시": (1, 0, 1, 1)}
    regions = spark.createDataFrame([("영등포구",), ("광명시",)], "region string")
    root = str(tmp_path / "site")
    update.publish(spark, root, "2026-10", merged, regions, 300, "2024-01", "2026-10")
    with pytest.raises(g.GuardError, match="invalid_complex"):
        update.publish(spark, root, "2026-11", merged, regions.limit(1), 300, "2024-01", "2026-10")
    from hanok.plans.publish import load_snapshot

    assert load_snapshot(spark, root)["leases"].count() == 1
    assert sorted(p.name for p in (tmp_path / "site" / "versions").iterdir()) == ["2026-10"]


MIXED = [
    ROW, dict(ROW, KAB_APTNM="테스트 ", DPOS_GBN="25.12.12"), dict(ROW, KAB_APTNM="다른", A11="2025.09.05"), dict(ROW, PNU=None), dict(ROW, code=None),
    dict(ROW, eup_scope=None), dict(ROW, A11="13.41"), dict(ROW, A31=""), dict(ROW, dong_code=None, A21="1.5"),
]


def test_bound_sites_link_as_keys_do(spark):
    rows, cat = responses(spark, MIXED), one(spark)
    plan = spark.createDataFrame([("41210", "10100", "A1")], "code string, dong_code string, complex_id string")
    for p in (None, plan):
        plain = cs.linked_contracts(cs.contracts(rows), cat, "2025-01", "2025-12", p)
        once = cs.linked_contracts(cs.contracts(rows, cs.bound(cs.sites_of(rows), cat, p)), cat, "2025-01", "2025-12", p)
        as_text = lambda df: sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect())
        assert sorted(plain.columns) == sorted(once.columns) and as_text(plain) == as_text(once)
        assert {r.complex_id for r in once.collect()} == {"A1", None}


def test_rows_find_their_site_by_one_number(spark):
    rows, cat = responses(spark, MIXED), one(spark)
    linked = cs.linked_contracts(cs.contracts(rows, cs.bound(cs.sites_of(rows), cat)), cat, "2025-01", "2025-12")
    plan = linked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # a date is parsed once a row, filters included
    joins = [line for line in plan.splitlines() if "Join " in line and "KAB_APTNM" in line]
    assert not joins


def test_spellings_that_share_a_mark_get_another_seed(spark, monkeypatch):
    rows, mark = responses(spark, MIXED), cs._mark
    expected = sorted(map(str, cs.contracts(rows).collect()))
    monkeypatch.setattr(cs, "_mark", lambda seed: F.lit(7).cast("bigint") if seed == 0 else mark(seed))
    sites = cs.sites_of(rows)
    assert sites.seed == 1
    assert sorted(map(str, cs.contracts(rows, sites).collect())) == expected
