"""Scans and sinks: the test tables are written in each source's own form and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hanok.functions import fixed_values as fv
from hanok.operators import guards as g
from hanok.plans import publish as pb
from hanok.plans import update as up
from hanok.registry import query
from hanok.session import scratch_path, scratch_scope
from hanok.sources import coverage_plan as cp
from hanok.sources import envelope as ev
from hanok.sources import listing as ls
from hanok.sources import lookups
from hanok.sources import part_store as ps
from hanok.sources import parts as pt
from hanok.sources import regional as rg
from hanok.sources import tabular as tb
from hanok.starmap import CATALOGUE, COMPLEX, LEASE, RAW_SALE, SALE

GUARD = '"guard"'


@query("envelope_scan", "S1", f"""WITH {RAW_SALE} SELECT cgg_cd, ctrt_day, bldg_nm, printf('%,d', thing_amt) AS thing_amt, CAST(l AS VARCHAR) AS flr FROM (SELECT *, flr AS l FROM raw_sale)""")
def envelope_scan(star):
    path = scratch_path(star.spark, "envelopes")
    # compressed files can't be split, so their length is bounded
    ev.to_envelopes(star.raw_sales()).write.option("compression", "gzip").option("maxRecordsPerFile", 100).text(path)
    return ev.envelope_rows(ev.read_envelopes(star.spark, path, lines=True), ["cgg_cd", "ctrt_day", "bldg_nm", "thing_amt", "flr"]).drop("file")


@query("envelope_violations", "S1 G20", f"""SELECT 'bad_envelope' AS {GUARD}, count(*) AS n FROM orders WHERE o_orderstatus <> 'F'""")
def envelope_violations(star):
    path = scratch_path(star.spark, "envelopes")
    row = F.to_json(F.struct(F.array(F.struct("o_orderkey", "o_orderstatus")).alias("DATA")))
    text = F.when(F.col("o_orderstatus") == "F", row).when(F.col("o_orderstatus") == "O", '{"DATA":[]}').otherwise("<html>maintenance</html>")
    star.table("orders").select(text.alias("value")).write.text(path)
    broken = ev.envelope_violations(ev.read_envelopes(star.spark, path, lines=True))
    return broken.groupBy("guard").agg(F.count("*").alias("n"))


def _archive(star, encoding):
    fields = {v: k for k, v in fv.ARCHIVE_FIELDS.items()}
    raw = star.raw_leases().withColumn("rcpt_yr", F.substring("ctrt_day", 1, 4)).withColumn("stdg_cd", F.lit("10100"))
    named = raw.select(*[F.coalesce(F.col(short), F.lit("")).alias(name) for short, name in fields.items()])
    path = scratch_path(star.spark, "archive")
    if encoding == "utf-8":
        named.write.option("header", True).csv(path)
        return path

    @F.pandas_udf("binary")
    def cp949_bytes(s):
        return s.map(lambda x: x.encode("cp949"))

    # the writer knows no CP949: bytes are written through the byte-preserving charset
    as_bytes = [F.decode(cp949_bytes(F.col(f"`{c}`")), "ISO-8859-1").alias(c.encode("cp949").decode("latin-1")) for c in named.columns]
    named.select(*as_bytes).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return path


ARCHIVE = f"""WITH {CATALOGUE} SELECT l_linenumber, bldg, day, kind, count(*) AS n FROM (SELECT l_linenumber, name || '아파트' AS bldg, strftime(l_shipdate, '%Y%m%d') AS day,
  CASE WHEN l_linenumber = 5 THEN '월세' ELSE '전세' END AS kind, unnest(generate_series(1, CASE WHEN l_returnflag = 'N' THEN 2 ELSE 1 END)) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN catalogue ON l_suppkey = complex_id
  WHERE l_linestatus = 'F' AND region = 'NATION_9' AND l_linenumber < 7) GROUP BY 1, 2, 3, 4"""


def _archive_counts(df):
    return df.filter("flr <> ''").groupBy(
        F.col("flr").cast("int").alias("l_linenumber"), F.col("bldg_nm").alias("bldg"), F.col("ctrt_day").alias("day"), F.col("rent_se").alias("kind")
    ).agg(F.count("*").alias("n"))


@query("archive_scan_utf8", "S2", ARCHIVE)
def archive_scan_utf8(star):
    return _archive_counts(tb.read_archive(star.spark, _archive(star, "utf-8"), "NATION_9"))


@query("archive_scan_cp949", "S2", ARCHIVE)
def archive_scan_cp949(star):
    return _archive_counts(tb.read_archive(star.spark, _archive(star, "cp949"), "NATION_9"))


@query("catalog_scan", "S3 P13 P14 P22 S10", f"""WITH {COMPLEX} SELECT region, name, '' || complex_id AS complex_id, CASE WHEN far IS NOT NULL THEN households END AS households, completed, build_year,
  CASE WHEN complex_id % 2 = 0 THEN '2,9당산' ELSE '모름' END AS station_display, CASE WHEN complex_id % 3 = 0 THEN NULL ELSE 0.5 END::DOUBLE AS station_distance_km FROM complex""")
def catalog_scan(star):
    k = F.col("complex_id")
    src = star.complexes.select(
        F.concat(F.lit("서울 "), "region", F.lit("구")).alias("자치구"), F.lit("").alias("아파트명"), F.col("name").alias("APT_NM"),
        F.concat("legal_dong", F.lit(" "), k.cast("string")).alias("주소"), k.cast("string").alias("단지 코드"),
        F.when(F.col("far").isNotNull(), F.format_number(F.col("households"), 0)).otherwise("nan").alias("세대수"),
        F.concat(F.replace("completed", F.lit("."), F.lit("-")), F.lit("-01")).alias("사용승인일"), F.lit("None").alias("건축연도"),
        F.when(k % 2 == 0, "당산역").otherwise("모름역").alias("지하철역"), F.when(k % 3 == 0, "").otherwise("0.5").alias("지하철역거리_km"),
    )
    path = scratch_path(star.spark, "catalog")
    src.write.option("header", True).csv(path)
    rows = star.spark.read.option("header", True).csv(path)
    out = tb.catalog_table(rows, [f"NATION_{i}구" for i in range(25)])
    return out.select(F.regexp_replace("region", "구$", "").alias("region"), "name", "complex_id", "households", "completed", "build_year", "station_display", "station_distance_km")


@query("xml_items", "S4 F2 F8", f"""SELECT s_name AS name, l_quantity + 40 AS area, l_linenumber AS floor, CAST(floor(l_extendedprice) AS BIGINT) AS price, strftime(l_shipdate, '%Y-%m-%d') AS date, count(*) AS n
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag <> 'R' AND l_tax < 0.07 AND (l_quantity + 40 BETWEEN 45 AND 74.9999 OR l_quantity + 40 BETWEEN 82 AND 86.5) GROUP BY 1, 2, 3, 4, 5""")
def xml_items(star):
    li = star.table("lineitem").join(star.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    d, korean = F.col("l_shipdate"), F.col("l_linestatus") == "F"
    values = {
        "name": F.col("s_name"), "area": F.col("l_quantity") + 40, "floor": F.col("l_linenumber"), "price": F.format_number(F.floor("l_extendedprice"), 0),
        "year": F.year(d), "month": F.month(d), "day": F.dayofmonth(d), "deal_type": F.when(F.col("l_tax") >= 0.07, "직거래").otherwise("중개거래"),
        "cancel_type": F.when(F.col("l_returnflag") == "R", "O").otherwise(""), "legal_dong": F.lit("당산동"), "apt_seq": F.col("l_suppkey"), "build_year": F.lit(2000),
    }
    tags = []
    for f, v in values.items():
        latin, hangul = tb.ITEM_NAMES[f][0], tb.ITEM_NAMES[f][-1]
        tags += [F.when(~korean, v.cast("string")).alias(latin), F.when(korean, v.cast("string")).alias(hangul)]
    path = scratch_path(star.spark, "items")
    tb.write_items(li.select(*tags), path)
    trades = tb.item_trades(tb.read_items(star.spark, path))
    return trades.groupBy("name", "area", "floor", "price", "date").agg(F.count("*").alias("n"))


@query("listing_links", "S8", r"""SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)">', 1)) AS target FROM pages""")
def listing_links(star):
    links = ls.blocks(star.table("pages"), "html", r'<a href="/[^"]*">[^<]*</a>', "page_id")
    return links.select("page_id", F.regexp_extract("block", r'<a href="/([^"]*)">', 1).alias("target"))


@query("archive_index", "S8", """SELECT CAST(year(o_orderdate) AS INT) AS year, '' || max(o_orderkey) AS seq, max_by(strftime(o_orderdate, '%Y.%m.%d.'), o_orderkey) AS published FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderstatus <> 'P' GROUP BY 1""")
def archive_index(star):
    o = star.table("orders")
    year = F.year("o_orderdate").cast("string")
    offer = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("""<a onclick="downloadFile('"""), F.col("o_orderkey").cast("string"), F.lit("""');">f</a>"""))).otherwise("")
    row = F.concat(F.lit('<tr class="r"><td title="서울특별시_전월세가_'), year, F.lit('.zip">'), offer, F.lit("</td><td>"), F.date_format("o_orderdate", "yyyy.MM.dd."), F.lit("</td></tr>"))
    # one file per page: the order key is the order of the pages
    pages = o.filter(F.year("o_orderdate") >= 2000).select("o_orderkey", F.concat(F.lit("<table>"), row, F.lit("</table>")).alias("html"))
    return ls.archive_index(pages, "html", "o_orderkey")


@query("latest_attachment", "S8", """SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, '' || o_orderkey AS seq, '1' AS number FROM orders WHERE o_orderstatus = 'F' AND year(o_orderdate) >= 2000 ORDER BY 1 DESC, 2 DESC LIMIT 1""")
def latest_attachment(star):
    o = star.table("orders")
    title = F.when(F.col("o_orderstatus") == "F", "관리비공개의무단지 기본정보").otherwise("다른 자료")
    row = F.concat(F.lit("<li>"), title, F.lit("("), F.date_format("o_orderdate", "yyyy.MM.dd"), F.lit(""")<a href="javascript:fileDown('"""), F.col("o_orderkey").cast("string"), F.lit("""','03','1');"></a></li>"""))
    return ls.latest_attachment(o.select(F.concat(F.lit("<ul><li>다른 자료</li>"), row, F.lit("</ul>")).alias("html")))


PLAN = f"""{COMPLEX}, dong AS (SELECT '41' || lpad('' || n_nationkey, 3, '0') AS code, n_name || '시' AS district, '' || (10100 + i) AS dong_code, CASE WHEN i = 3 THEN '남양읍 DONG_0' ELSE 'DONG_' || i END AS dong FROM nation, (VALUES (0), (1), (3)) v(i)),
cat AS (SELECT complex_id, region, CASE WHEN households > 700 AND legal_dong = 'DONG_0' THEN '남양읍 DONG_0' ELSE legal_dong END AS legal_dong FROM complex),
hit AS (SELECT code, dong_code, dong, complex_id, region FROM dong JOIN cat ON region || '시' = district AND legal_dong = dong)"""


def _plan_inputs(star):
    c = star.complexes.select(
        "complex_id", "region", F.col("region").alias("district"),
        F.when((F.col("households") > 700) & (F.col("legal_dong") == "DONG_0"), "남양읍 DONG_0").otherwise(F.col("legal_dong")).alias("legal_dong"),
    )
    n = star.table("nation")
    d = n.select(
        F.concat(F.lit("41"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("code"), F.concat("n_name", F.lit("시")).alias("district_name"),
        F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("i"),
    )
    name = F.when(F.col("i") == 3, "남양읍 DONG_0").otherwise(F.concat(F.lit("DONG_"), F.col("i").cast("string")))
    return c, d.select("code", "district_name", (10100 + F.col("i")).cast("string").alias("dong_code"), name.alias("dong_name"))


@query("coverage_jobs", "S11", f"""WITH {PLAN}, e AS (SELECT code, dong_code, dong, any_value(region) AS region, count(*) AS complexes FROM hit GROUP BY 1, 2, 3)
SELECT code, dong_code, dong, region, complexes, CAST(dong LIKE '남양읍%' AS INT) AS eup_scope, y AS year, greatest('1999-06', y || '-01') AS from_month, least('2001-10', y || '-12') AS to_month FROM e, (VALUES (1999), (2000), (2001)) v(y)""")
def coverage_jobs(star):
    plan = cp.coverage_plan(*_plan_inputs(star))
    out = cp.jobs(plan, "1999-06", "2001-10")
    return out.select("code", "dong_code", "dong", "region", "complexes", F.col("eup_scope").cast("int").alias("eup_scope"), "year", "from_month", "to_month")


@query("uncovered_complexes", "S11 G10", f"""WITH {PLAN} SELECT '' || complex_id AS key FROM cat WHERE complex_id NOT IN (SELECT complex_id FROM hit) UNION ALL SELECT DISTINCT region FROM cat WHERE region NOT IN (SELECT region FROM hit)""")
def uncovered_complexes(star):
    c, d = _plan_inputs(star)
    hit = cp.plan_complexes(c, d)
    return cp.uncovered(c, hit).select(F.col("complex_id").cast("string").alias("key")).unionByName(cp.cities_without_plan(c, hit).select("key"))


@query("former_district_plan", "S11", f"""WITH {PLAN} SELECT DISTINCT '41590' AS code, '' || (10100 + i) AS dong_code, CASE i WHEN 0 THEN '오산동' ELSE '남양읍' END AS dong, complex_id FROM cat, (VALUES (0), (1)) v(i)
WHERE (i = 0 AND legal_dong = 'DONG_1') OR (i = 1 AND legal_dong LIKE '남양읍 %')""")
def former_district_plan(star):
    c, _ = _plan_inputs(star)
    # two former dongs of one district: a renamed one and an eup
    first = star.table("region").filter("r_regionkey <= 1")
    d = first.select(
        F.lit("41590").alias("code"), (10100 + F.col("r_regionkey")).cast("string").alias("dong_code"),
        F.when(F.col("r_regionkey") == 0, "오산동").otherwise("남양읍").alias("dong_name"),
    )
    renamed = first.filter("r_regionkey = 0").select(F.lit("오산동").alias("old_dong"), F.lit("DONG_1").alias("canonical"))
    return cp.former_district_plan(c, d, renamed).select("code", "dong_code", "dong", "complex_id")


@query("union_of_regions", "S9 G16", f"""WITH {COMPLEX} SELECT province, count(*) AS n, CAST(sum(households) AS BIGINT) AS households FROM complex GROUP BY 1""")
def union_of_regions(star):
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    c = star.complexes.withColumn("address", F.col("legal_dong"))
    parts = [c.filter(F.col("province") == n) for n in names]
    status = star.table("region").select(F.col("r_name").alias("region"), F.lit(3).alias("months_requested"), F.lit(3).alias("months_succeeded"))
    merged, problems = rg.union_regions(parts, status, star.table("region").select(F.col("r_name").alias("region")))
    g.enforce(problems)
    return merged.groupBy("province").agg(F.count("*").alias("n"), F.sum("households").alias("households"))


@query("station_line_lookup", "S10 P22", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '2,9' WHEN c_mktsegment = 'MACHINERY' THEN '9,신림' END AS lines FROM customer""")
def station_line_lookup(star):
    seg = F.col("c_mktsegment")
    c = star.table("customer").withColumn("station", F.when(seg == "BUILDING", "당산").when(seg == "MACHINERY", "샛강").otherwise("모름"))
    return c.join(lookups.station_lines(star.spark), "station", "left").select("c_custkey", "lines")


ROW = "struct<id:bigint,name:string,region:string,households:int,tx:array<struct<date:string,area:double,floor:int,price:bigint>>>"


def _published(star):
    c = star.complexes.select("complex_id", "name", "region", "households")
    sales = star.sales.select("complex_id", "ym", F.col("date").cast("string").alias("date"), "area", "floor", "price")
    leases = star.leases.select("complex_id", "ym", F.col("date").cast("string").alias("date"), "area", "floor", "deposit", "kind")
    docs, sizes = up.documents(c, sales, leases)
    g.enforce(pt.oversized(sizes))
    path = scratch_path(star.spark, "parts")
    with scratch_scope(star.spark):  # the documents go once they are packed
        pt.pack_parts(docs, max_bytes=256 * 1024).write.parquet(path + "-packed")
    packed = star.spark.read.parquet(path + "-packed")
    pt.write_parts(packed, path)
    return path, packed.drop("text"), c


@query("published_parts", "K1 S5 S6 O1 P23 K4", f"""WITH {SALE}, {COMPLEX} SELECT complex_id AS id, region, households, count(price) AS trades, CAST(sum(price) AS BIGINT) AS total FROM complex LEFT JOIN sale USING (complex_id) GROUP BY 1, 2, 3""")
def published_parts(star):
    path, manifest, c = _published(star)
    rows, problems = pt.load_parts(star.spark, path, manifest, c.count(), ROW)
    g.enforce(problems)
    total = F.aggregate("tx", F.lit(0).cast("bigint"), lambda a, t: a + t["price"])
    return rows.select("id", "region", "households", F.greatest(F.size("tx"), F.lit(0)).cast("bigint").alias("trades"), F.when(F.size("tx") > 0, total).alias("total"))


def _documents(star):
    c = star.complexes.select("complex_id", "name", "region", "households")
    sales = star.sales.select("complex_id", "ym", F.col("date").cast("string").alias("date"), "area", "floor", "price")
    leases = star.leases.select("complex_id", "ym", F.col("date").cast("string").alias("date"), "area", "floor", "deposit", "kind")
    return {"complexes": c, "sales": sales, "leases": leases}


@query("stored_parts", "K1 K3 S6 G13 G14", f"""WITH {SALE}, {COMPLEX} SELECT row_number() OVER (ORDER BY region, complex_id) AS ord, complex_id AS id, region, households, count(price) AS trades, CAST(sum(price) AS BIGINT) AS total
FROM complex LEFT JOIN sale USING (complex_id) GROUP BY complex_id, region, households""")
def stored_parts(star):
    """The publish job's parts, written by the sink with its commit and read back by the source with all checks."""
    path = scratch_path(star.spark, "store")
    up.publish_parts(star.spark, path, "first", _documents(star), 256 * 1024)
    rows, problems = ps.load_store(star.spark, path, ROW)
    g.enforce(problems)
    total = F.aggregate("tx", F.lit(0).cast("bigint"), lambda a, t: a + t["price"])
    return rows.select("ord", "id", "region", "households", F.greatest(F.size("tx"), F.lit(0)).cast("bigint").alias("trades"), F.when(F.size("tx") > 0, total).alias("total"))


@query("parts_of_regions", "S6", f"""WITH {COMPLEX} SELECT region, count(*) AS n FROM complex WHERE region LIKE '%1' OR region LIKE '%A' GROUP BY 1""")
def parts_of_regions(star):
    """Some regions of a store: only their parts are opened."""
    path = scratch_path(star.spark, "store")
    up.publish_parts(star.spark, path, "first", _documents(star), 64 * 1024)
    wanted = sorted(p["region"] for p in ps.Store(path).manifest()["parts"] if p["region"].endswith(("1", "A")))
    rows, problems = ps.load_store(star.spark, path, ROW, regions=wanted)
    g.enforce(problems)
    return rows.groupBy("region").agg(F.count("*").alias("n"))


@query("tampered_parts", "S6 G13 G14 G15", f"""WITH {COMPLEX} SELECT 'part' AS {GUARD}, 'count' AS detail, CAST(count(DISTINCT region) > 0 AS INT) AS found FROM complex UNION ALL SELECT 'part', 'hash', 1 UNION ALL SELECT 'complex_count', '' || count(*), 1 FROM complex UNION ALL SELECT 'part_listed_twice', '2', 1""")
def tampered_parts(star):
    """A manifest that contradicts the parts: wrong hash in some regions, wrong count in others, one part listed twice."""
    path, manifest, c = _published(star)
    region = F.col("region")
    wrong = manifest.withColumn("sha256", F.when(region.endswith("1"), "0").otherwise(F.col("sha256"))).withColumn("count", F.when(region.endswith("2"), 0).otherwise(F.col("count")))
    first = manifest.agg(F.min("file").alias("file"))
    twice = wrong.unionByName(manifest.join(first, "file", "left_semi").filter(~region.endswith("1") & ~region.endswith("2")))
    _, problems = pt.load_parts(star.spark, path, wrong, c.count() + 1, ROW)
    again = g.duplicated(wrong.unionByName(wrong.join(first, "file", "left_semi")), ["file"], "part_listed_twice")
    return problems.unionByName(again).groupBy("guard", "detail").agg(F.lit(1).alias("found"))


@query("snapshot_versions", "K2 K3 S6 G13", f"""WITH {SALE}, {LEASE} SELECT 'current' AS which, 'sales' AS tab, count(*) AS n FROM sale UNION ALL SELECT 'current', 'leases', count(*) FROM lease
UNION ALL SELECT 'previous', 'sales', count(*) FROM sale WHERE floor >= 9 UNION ALL SELECT 'previous', 'leases', count(*) FROM lease""")
def snapshot_versions(star):
    """Three versions are published; the last two can be loaded and are checked on the way in."""
    root = scratch_path(star.spark, "snapshots")
    order = ("complex_id", "date")
    year = F.substring("ym", 1, 4).alias("year")
    lease = (star.leases.select("*", year), "year", order)
    for version, least in (("v1", 12), ("v2", 9), ("v3", 0)):
        tables = {"sales": (star.sales.select("*", year).filter(F.col("floor") >= least), "year", order), "leases": lease}
        pb.publish_snapshot(star.spark, root, version, tables, lambda staged: [g.minimum_rows(staged["sales"], 1)])
    out = None
    for which in ("current", "previous"):
        for name, df in pb.load_snapshot(star.spark, root, which).items():
            n = df.agg(F.count("*").alias("n")).select(F.lit(which).alias("which"), F.lit(name).alias("tab"), "n")
            out = n if out is None else out.unionByName(n)
    return out
