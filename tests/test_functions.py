import datetime as dt
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hanok.functions import months as mo
from hanok.functions import parcels as pa
from hanok.functions import places as pl
from hanok.functions import text as tx
from hanok.functions import values as va


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def plain_norm(s):
    return re.sub("[^0-9a-z가-힣]", "", unicodedata.normalize("NFKC", s).lower().replace("아파트", ""))


def test_norm_equals_nfkc_on_single_characters(spark):
    rows = [(cp, chr(cp)) for cp in range(1, 0x1D800) if not 0xD800 <= cp <= 0xDFFF and not unicodedata.combining(chr(cp))]
    df = spark.createDataFrame(rows, "cp int, s string").select("s", tx.norm(F.concat(F.lit("A"), "s", F.lit("가"))).alias("n"))
    wrong = [(r.s, r.n) for r in df.collect() if plain_norm("A" + r.s + "가") != r.n]
    assert wrong == [] or all(0x1100 <= ord(s) <= 0x11FF for s, _ in wrong)


def test_norm_equals_nfkc_on_mixed_texts(spark):
    seen = []

    @settings(max_examples=60, deadline=None)
    @given(st.text(alphabet="ABab01 -(）（１２ＡｂⅡ㎡①㈜½가나다아파트ｱ", max_size=20))
    def collect(s):
        seen.append(s)

    collect()
    df = spark.createDataFrame([(s,) for s in seen], "s string")
    assert values(df, tx.norm("s")) == [plain_norm(s) for s in seen]
    assert values(df, tx.norm("s", exact=True)) == [plain_norm(s) for s in seen]


def test_exact_norm_handles_separate_jamo(spark):
    decomposed = unicodedata.normalize("NFD", "한솔마을")
    assert values(spark.createDataFrame([(decomposed,)], "s string"), tx.norm("s", exact=True)) == ["한솔마을"]


def test_bracketed_names(frame):
    df = frame([{"s": s} for s in ("(91-511)", "래미안(1차)", "HAPPY APT", "아파트", None)])
    assert values(df, tx.norm_name("s")) == ["91511", "래미안", "happy", "", ""]


def test_station_names(frame):
    df = frame([{"s": s} for s in ("당산역", "동탄 (SRT)역", "역삼역", None)])
    assert values(df, tx.station_name("s")) == ["당산", "동탄", "역삼", ""]


def test_line_labels(spark):
    cases = [
        ({"route": "subway", "name": "서울 지하철 9호선 김포공항 - 중앙보훈병원"}, ["9"]),
        ({"route": "train", "name": "공항철도 인천공항 - 서울역"}, ["공항"]),
        ({"route": "subway", "name": "서울 지하철 2호선 신림역"}, ["2"]),
        ({"route": "light_rail", "name": "신림선"}, ["신림"]),
        ({"name": "신분당선", "route": "train"}, ["신분당"]),
        ({"name": "수인분당선", "route": "train"}, ["수인분당"]),
        ({"name": "신분당선 수인분당선"}, ["수인분당", "신분당"]),
        ({"name": "강변", "ref": "214", "station": "subway"}, []),
        ({"name": "당산", "operator": "서울시메트로9호선"}, ["9"]),
        ({"name": "수도권 광역급행철도 GTX-A", "route": "train"}, ["GTX-A"]),
        ({"route": "subway", "ref": "3"}, ["3"]),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "tags map<string,string>")
    assert values(df, pl.line_labels("tags")) == [want for _, want in cases]


def test_parcels(frame):
    df = frame([{"m": "0001", "s": "0000"}, {"m": "0012", "s": "0003"}, {"m": "5", "s": None}, {"m": "x", "s": "1"}])
    assert values(df, pa.parcel("m", "s")) == ["1", "12-3", "5", None]


def test_parcel_evidence(frame):
    rows = [
        {"d": "12-3번지", "a": "서울특별시 영등포구 당산동 12-3 단지"},
        {"d": "12-3", "a": "서울특별시 영등포구 당산동 7"},
        {"d": "당산동 9", "a": ""},
        {"d": "단지이름", "a": "서울특별시 영등포구 당산동 산 7"},
        {"d": "", "a": "서울특별시 마포구 당산동 7"},
    ]
    e = pa.parcel_evidence("d", "a", F.lit("영등포구"), F.lit("당산동"))
    got = [tuple(r[0]) for r in frame(rows).select(e).collect()]
    assert got == [("12-3", "daddr+stdg_addr"), ("", "conflict"), ("9", "daddr"), ("", "stdg_addr_only_untrusted"), ("", "none")]


def test_legal_parcels(frame):
    df = frame([
        {"a": "경기도 광명시 광명동 309-1 테스트", "e": "", "d": "광명동"},
        {"a": "경기도 광명시 광명동 309-1,경기도 광명시 광명동 산 310 테스트", "e": "", "d": "광명동"},
        {"a": "경기도 화성시 남양읍 남양리 12-0 단지", "e": "남양읍", "d": "남양리"},
        {"a": "경기도 화성시 12", "e": "", "d": ""},
    ])
    got = [[tuple(p) for p in r[0]] for r in df.select(pa.legal_parcels("a", "e", "d")).collect()]
    assert got == [[("1", "309-1")], [("1", "309-1"), ("2", "310")], [("1", "12")], []]


def test_road_and_pnu(frame):
    df = frame([{"a": "서울특별시 영등포구 검증로 10-2"}, {"a": "영등포구"}])
    assert [r[0] and tuple(r[0]) for r in df.select(pa.road_key("a")).collect()] == [("검증로", 10, 2), None]
    df = frame([{"p": "4121010100103090001", "m": "199805"}, {"p": "41210", "m": "1998"}, {"p": "4121010100103090001", "m": ""}])
    assert [r[0] and tuple(r[0]) for r in df.select(pa.pnu_identity("p", "m")).collect()] == [("41210", "10100", "1", "309-1", 1998), None, None]


def test_disclosed_dates(frame):
    rows = [("09.04", 2025), ("25.09.04", 2026), ("20250904", 2020), ("02.30", 2025), ("", 2025), ("2025.1.2", 1), ("1.2.3.4", 2025)]
    df = frame([{"v": v, "y": y} for v, y in rows])
    assert values(df, va.disclosed_date("v", F.col("y").cast("int"))) == [
        dt.date(2025, 9, 4), dt.date(2025, 9, 4), dt.date(2025, 9, 4), None, None, dt.date(2025, 1, 2), None
    ]


def test_numbers(frame):
    df = frame([{"v": v} for v in ("100,000", " 59.9 ", "nan", "inf", "", None, "1e3", "12d", "abc", "-3")])
    assert values(df, va.number("v")) == [100000.0, 59.9, None, None, None, None, 1000.0, None, None, -3.0]
    assert values(frame([{"v": v} for v in ("2.5", "3.5", "10%", "x")]), va.whole("v")) == [2, 4, 10, None]
    assert values(frame([{"v": v} for v in ("12", "12.5", "", "+7")]), va.integer("v")) == [12, None, None, 7]


def test_completed_months(frame):
    df = frame([{"v": v} for v in ("1998-05-01", "19980501", "894000000000", "1998", "")])
    assert values(df, va.completed("v")) == ["1998.05", "1998.05", "1998.05", "1998", None]
    # one second before midnight in Seoul still belongs to the old month
    edge = frame([{"v": "1793458799000"}, {"v": "1793458800000"}])
    assert values(edge, va.completed("v")) == ["2026.10", "2026.11"]


def test_closed_month_in_seoul(spark):
    cases = [
        ("2026-10-31 14:59:59", "2026-09"), ("2026-10-31 15:00:00", "2026-10"), ("2026-12-31 15:00:00", "2026-12"),
        ("2027-01-01 00:00:00", "2026-12"), ("2024-03-01 00:00:00", "2024-02"),
    ]
    df = spark.createDataFrame(cases, "t string, want string").select(F.col("t").cast("timestamp_ntz").alias("t"), "want")
    assert values(df, mo.last_closed_month("t")) == [w for _, w in cases]


def test_month_range(frame):
    df = frame([{"a": "2025-12", "b": "2026-02"}, {"a": "2026-03", "b": "2026-02"}])
    assert values(df, mo.months_between_inclusive("a", "b")) == [["2025-12", "2026-01", "2026-02"], None]


def test_display(frame):
    df = frame([{"v": v} for v in ("105000", "100000", "12345.5", None)])
    assert values(df, va.money(F.col("v").cast("double"))) == ["10.5억", "10억", "1.23억", "—"]
    assert values(df.limit(1), va.signed_percent(F.lit(-3.25))) == ["-3.3%"]
    assert values(df.limit(1), va.display_name(F.lit("당산푸르지오"), F.lit("2,9당산역"))) == ["당산푸르지오(2,9당산역)"]
    assert values(df.limit(1), va.search_url("u?sk=", F.lit("가 a/b~*"))) == ["u?sk=%EA%B0%80%20a/b~%2A"]


def test_region_tags(frame):
    rows = [("성남시", "성남분당구", "정자동"), ("화성시", "화성동탄구", "반송동"), ("안양시", "안양동안구", "평촌동"), ("안양시", "안양동안구", "호계동")]
    df = frame([{"r": a, "d": b, "l": c} for a, b, c in rows])
    assert values(df, pl.region_tags("r", "d", "l")) == [["성남시", "분당구"], ["화성시", "동탄구", "동탄시"], ["안양시", "동안구", "평촌동"], ["안양시", "동안구"]]


def test_decomposed_hangul_is_composed(spark):
    import unicodedata

    names = ["한솔마을", "각가간", "A한 빛Ⅱ", "값진", "ᄀ", "힣힐"]
    rows = spark.createDataFrame([(n, unicodedata.normalize("NFD", n)) for n in names], "nfc string, nfd string")
    for r in rows.select("nfc", tx.composed("nfd").alias("c"), tx.norm("nfc").alias("a"), tx.norm("nfd").alias("b"), tx.norm_name("nfc").alias("x"), tx.norm_name("nfd").alias("y")).collect():
        assert r.c == r.nfc and r.a == r.b and r.x == r.y
