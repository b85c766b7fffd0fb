"""Dedupe, incremental replacement, merging and comparing snapshots, ordering, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hanok.functions.months import ym_of_date
from hanok.operators import coverage as cv
from hanok.operators import dedupe as dd
from hanok.operators import incremental as inc
from hanok.operators import trees as tr
from hanok.operators.ranking import number_rows
from hanok.registry import query
from hanok.starmap import COMPLEX, LEASE, SALE, TRADE

START, END = "1998-01", "1999-06"
COLS = ["complex_id", "ym", "area", "floor", "price"]


@query("copies_removed", "D1 D2", """SELECT CAST(sum(n) AS BIGINT) AS "rows", count(*) AS distinct_rows, CAST(sum(n - 1) AS BIGINT) AS removed FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def copies_removed(star):
    return dd.copies_removed(star.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("distinct_trades", "D2 W6", f"""WITH {SALE} SELECT DISTINCT complex_id, ym, area, floor FROM sale""")
def distinct_trades(star):
    return dd.distinct_rows(star.sales.select("complex_id", "ym", "area", "floor"), ["complex_id", "ym", "area", "floor"])


PARTS = """parts AS (SELECT p_partkey AS complex_id, p_brand AS region, CASE WHEN p_size % 2 = 0 THEN p_name || ' 아파트' ELSE upper(p_name) || '(1차)' END AS name, p_type AS address,
   CASE WHEN p_size > 10 THEN p_size END AS households, CASE WHEN p_size > 20 THEN 'station' || p_size ELSE '' END AS station FROM part)"""


def _parts(star):
    size = F.col("p_size")
    return star.table("part").select(
        F.col("p_partkey").alias("complex_id"), F.col("p_brand").alias("region"),
        F.when(size % 2 == 0, F.concat("p_name", F.lit(" 아파트"))).otherwise(F.concat(F.upper("p_name"), F.lit("(1차)"))).alias("name"),
        F.col("p_type").alias("address"), F.when(size > 10, size).alias("households"),
        F.when(size > 20, F.concat(F.lit("station"), size.cast("string"))).otherwise("").alias("station"), F.col("p_partkey").alias("ord"),
    )


COLLAPSED = f"""{PARTS}, keyed AS (SELECT *, replace(regexp_replace(lower(regexp_replace(name, '\\([^)]*\\)', '', 'g')), '[^0-9a-z가-힣]', '', 'g'), '아파트', '') AS n FROM parts),
merged AS (SELECT min(complex_id) AS complex_id, region, n, address, arg_min(name, complex_id) AS name, arg_min(households, complex_id) FILTER (households IS NOT NULL) AS households,
  arg_min(station, complex_id) FILTER (station <> '') AS station FROM keyed GROUP BY region, n, address)"""


@query("collapsed_complexes", "D3 P2 W6", f"""WITH {COLLAPSED} SELECT complex_id, region, name, address, households, station FROM merged""")
def collapsed_complexes(star):
    return dd.collapse_complexes(_parts(star))[0].drop("ord")


@query("rekeyed_trades", "D3", f"""WITH {SALE}, {COLLAPSED}, map AS (SELECT k.complex_id AS old_id, m.complex_id FROM keyed k JOIN merged m USING (region, n, address))
SELECT DISTINCT map.complex_id, ym, area, floor FROM sale JOIN map ON part_key = old_id""")
def rekeyed_trades(star):
    _, renamed = dd.collapse_complexes(_parts(star))
    trades = star.sales.withColumn("complex_id", F.col("part_key"))
    return dd.rekey_trades(trades, renamed, ["ym", "area", "floor"])


@query("trade_only_complexes", "D4", f"""WITH {SALE}, t AS (SELECT p_brand AS region, p_name AS name, lpad('' || order_key, 8, '0') AS apt_seq, date, p_size + 1970 AS build_year, p_type AS legal_dong, '' || part_key AS jibun
    FROM sale JOIN part ON part_key = p_partkey),
g AS (SELECT *, regexp_replace(name, '[^0-9a-z가-힣]', '', 'g') AS match_name, row_number() OVER (PARTITION BY region, regexp_replace(name, '[^0-9a-z가-힣]', '', 'g') ORDER BY date, apt_seq, jibun) AS rn FROM t)
SELECT min(apt_seq) AS complex_id, region, match_name, count(*) AS trades, min(strftime(date, '%Y-%m-%d')) AS first_date FROM g GROUP BY region, match_name""")
def trade_only_complexes(star):
    t = star.sales.join(star.table("part"), F.col("part_key") == F.col("p_partkey")).select(
        F.col("p_brand").alias("region"), F.col("p_name").alias("name"), F.lpad(F.col("order_key").cast("string"), 8, "0").alias("apt_seq"), "date",
        (F.col("p_size") + 1970).alias("build_year"), F.col("p_type").alias("legal_dong"), F.col("part_key").cast("string").alias("jibun"),
    )
    made = dd.trade_only_complexes(t)
    first = t.groupBy("region", dd.norm_name("name").alias("match_name")).agg(F.min("date").cast("string").alias("first_date"))
    return made.join(first, ["region", "match_name"]).select("complex_id", "region", "match_name", "trades", "first_date")


SNAPSHOTS = f"""{TRADE}, stored AS (SELECT * FROM trade WHERE NOT cancelled), fresh AS (SELECT * FROM trade WHERE cancelled AND ym BETWEEN '{START}' AND '{END}')"""


def _snapshots(star):
    """Stored: the active trades; fresh: other rows of the refreshed months."""
    t = star.trades
    return t.filter(~F.col("cancelled")).select(*COLS), t.filter(F.col("cancelled") & F.col("ym").between(START, END)).select(*COLS)


def _sums(df, *by):
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("price").alias("total"))


@query("replaced_window", "D5", f"""WITH {SNAPSHOTS} SELECT ym, count(*) AS n, CAST(sum(price) AS BIGINT) AS total FROM (SELECT ym, price FROM stored WHERE ym NOT BETWEEN '{START}' AND '{END}' UNION ALL SELECT ym, price FROM fresh) GROUP BY 1""")
def replaced_window(star):
    return _sums(inc.replace_window(*_snapshots(star), START, END), "ym")


@query("overwritten_months", "D5 K1", f"""WITH {SNAPSHOTS} SELECT ym, count(*) AS n, CAST(sum(price) AS BIGINT) AS total FROM (SELECT ym, price FROM stored WHERE ym NOT IN (SELECT ym FROM fresh) UNION ALL SELECT ym, price FROM fresh) GROUP BY 1""")
def overwritten_months(star):
    """The same on a stored table, by overwriting only the month partitions that arrive."""
    from hanok.session import scratch_path

    stored, fresh = _snapshots(star)
    path = scratch_path(star.spark, "months")
    inc.overwrite_months(stored.repartition("ym"), path)
    inc.overwrite_months(fresh.repartition("ym"), path)
    months = star.spark.read.schema("complex_id bigint, area double, floor int, price bigint, ym string").parquet(path)
    return _sums(months, "ym")


@query("preserved_history", "D6", f"""WITH {SNAPSHOTS}, {COMPLEX} SELECT ym, count(*) AS n, CAST(sum(price) AS BIGINT) AS total FROM (SELECT ym, price FROM stored WHERE ym < '{START}' AND complex_id IN (SELECT complex_id FROM complex WHERE far IS NOT NULL)
  UNION ALL SELECT ym, price FROM fresh) GROUP BY 1""")
def preserved_history(star):
    return _sums(inc.preserve_history(*_snapshots(star), star.complexes.filter("far is not null"), START), "ym")


@query("identity_conflicts", "D6", f"""WITH {COMPLEX} SELECT '' || complex_id AS key, 'build_year' AS detail, 'identity_conflict' AS "guard" FROM complex WHERE province = 'ASIA'
UNION ALL SELECT '' || complex_id, 'legal_dong', 'identity_conflict' FROM complex WHERE households < 300""")
def identity_conflicts(star):
    now = star.complexes
    before = now.withColumn("build_year", F.when(F.col("province") == "ASIA", F.col("build_year") - 1).otherwise(F.col("build_year"))).withColumn(
        "legal_dong", F.when(F.col("households") < 300, F.lit("old")).otherwise(F.col("legal_dong"))
    )
    return inc.identity_conflicts(before, now)


@query("frozen_history", "D8", f"""WITH {SNAPSHOTS} SELECT ym, count(*) AS n, CAST(sum(price) AS BIGINT) AS total FROM (SELECT ym, price FROM stored WHERE ym >= '1996-03' AND ym < '{START}' UNION ALL SELECT ym, price FROM fresh) GROUP BY 1""")
def frozen_history(star):
    return _sums(inc.freeze_history(*_snapshots(star), "1996-03", START), "ym")


@query("backfilled", "J11", f"""WITH {SNAPSHOTS}, {COMPLEX}, new AS (SELECT complex_id FROM complex WHERE province IN ('ASIA', 'EUROPE'))
SELECT complex_id, count(*) AS n, CAST(sum(price) AS BIGINT) AS total FROM (SELECT complex_id, price FROM fresh WHERE complex_id NOT IN (FROM new) UNION ALL SELECT complex_id, price FROM stored WHERE complex_id IN (FROM new)) GROUP BY 1""")
def backfilled(star):
    stored, fresh = _snapshots(star)
    known = star.complexes.filter("province not in ('ASIA', 'EUROPE')")
    return _sums(inc.backfill_new(fresh, stored, star.complexes, known), "complex_id")


@query("refresh_starts", "D7 P15", """WITH m AS (SELECT o_orderkey, o_orderdate, o_orderstatus = 'F' AS f, o_orderpriority <> '5-LOW' AS v FROM orders)
SELECT o_orderkey, CASE WHEN NOT f AND v THEN greatest('1996-01', least('2000-11', strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m'))) ELSE '1996-01' END AS refresh_start FROM m""")
def refresh_starts(star):
    meta = star.table("orders").select(
        "o_orderkey", ym_of_date("o_orderdate").alias("previous"), F.lit("1996-01").alias("configured"), F.lit("2001-10").alias("end"),
        (F.col("o_orderstatus") == "F").alias("full"), (F.col("o_orderpriority") != "5-LOW").alias("verified"),
    )
    return inc.with_refresh_start(meta).select("o_orderkey", "refresh_start")


@query("due_runs", "D9 P15", """SELECT event_id, CAST(CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 0 WHEN 'view' THEN 1 ELSE CASE WHEN strftime(ts - INTERVAL 20 DAY, '%Y-%m') < strftime(ts + INTERVAL 9 HOUR - INTERVAL 1 MONTH, '%Y-%m') THEN 1 ELSE 0 END END AS INT) AS due FROM events""")
def due_runs(star):
    from hanok.functions.months import last_closed_month

    kind = F.col("event_type")
    meta = star.table("events").select(
        "event_id",
        F.when(kind == "click", "workflow_dispatch").when(kind == "error", "pull_request").when(kind == "purchase", "push").otherwise("schedule").alias("event"),
        F.when(kind != "view", F.date_format(F.expr("ts - interval 20 days"), "yyyy-MM")).alias("published"), last_closed_month("ts").alias("closed"),
    )
    return inc.with_due(meta).select("event_id", F.col("due").cast("int").alias("due"))


@query("merged_providers", "D11 S9", f"""WITH {SALE}, {LEASE} SELECT provider, ym, count(*) AS n, CAST(sum(price) AS BIGINT) AS total, count(kind) AS kinds FROM (SELECT 'official' AS provider, ym, price, NULL AS kind FROM sale UNION ALL SELECT 'portal', ym, deposit, kind FROM lease) GROUP BY 1, 2""")
def merged_providers(star):
    portal = star.leases.withColumnRenamed("deposit", "price")
    both = inc.merge_providers(("official", star.sales), ("portal", portal))
    return both.groupBy("provider", "ym").agg(F.count("*").alias("n"), F.sum("price").alias("total"), F.count("kind").alias("kinds"))


@query("snapshot_diff", "D12", f"""WITH {TRADE}, a AS (SELECT complex_id, ym, area, floor FROM trade WHERE NOT cancelled), b AS (SELECT complex_id, ym, area, floor FROM trade WHERE cancelled OR ym < '1999-01')
SELECT complex_id, ym, area, floor, CASE WHEN n > 0 THEN 'added' ELSE 'removed' END AS change, CAST(abs(n) AS BIGINT) AS copies FROM (SELECT complex_id, ym, area, floor, sum(s) AS n FROM
  (SELECT *, -1 AS s FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY 1, 2, 3, 4) WHERE n <> 0""")
def snapshot_diff(star):
    t = star.trades
    return inc.snapshot_diff(t.filter(~F.col("cancelled")), t.filter(F.col("cancelled") | (F.col("ym") < "1999-01")), ["complex_id", "ym", "area", "floor"])


@query("changed_orders", "D12", """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'removed' WHEN o_orderpriority = '2-HIGH' THEN 'added' ELSE 'changed' END AS change FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus = 'P'""")
def changed_orders(star):
    o = star.table("orders")
    before = o.filter("o_orderpriority <> '2-HIGH'")
    after = o.filter("o_orderpriority <> '1-URGENT'").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")))
    return inc.changed_keys(before, after, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


THREE = """b AS (SELECT o_orderkey AS path, o_orderstatus AS value FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'),
l AS (SELECT o_orderkey AS path, CASE WHEN o_orderpriority = '1-URGENT' THEN 'local' ELSE o_orderstatus END AS value FROM orders WHERE o_orderpriority <> '2-HIGH'),
r AS (SELECT o_orderkey AS path, CASE WHEN o_orderstatus = 'F' THEN 'remote' ELSE o_orderstatus END AS value FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' AND o_orderdate < TIMESTAMP '2001-01-01')"""


@query("three_way_merge", "J19", f"""WITH {THREE}, j AS (SELECT path, b.value AS b, l.value AS l, r.value AS r FROM b FULL JOIN l USING (path) FULL JOIN r USING (path)),
m AS (SELECT path, CASE WHEN b IS NOT DISTINCT FROM l THEN r ELSE l END AS value, CASE WHEN l IS NOT DISTINCT FROM r THEN 'same' WHEN b IS NOT DISTINCT FROM l THEN 'remote' WHEN b IS NOT DISTINCT FROM r THEN 'local' ELSE 'both' END AS origin FROM j)
SELECT path, value, origin FROM m WHERE value IS NOT NULL""")
def three_way_merge(star):
    o, p, s = star.table("orders").withColumn("path", F.col("o_orderkey")), F.col("o_orderpriority"), F.col("o_orderstatus")
    base = o.filter(p != "4-NOT SPECIFIED").select("path", s.alias("value"))
    local = o.filter(p != "2-HIGH").select("path", F.when(p == "1-URGENT", "local").otherwise(s).alias("value"))
    kept = o.filter((p != "4-NOT SPECIFIED") & (F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz")))
    remote = kept.select("path", F.when(s == "F", "remote").otherwise(s).alias("value"))
    return inc.three_way(base, local, remote, ["path"])


@query("newest_presets", "O3", """SELECT o_custkey, o_orderkey, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 10""")
def newest_presets(star):
    o = star.table("orders").select("o_custkey", "o_orderkey", "o_orderdate")
    kept = inc.newest(o, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return kept.select("o_custkey", "o_orderkey", F.col("place").cast("bigint").alias("place"))


@query("canonical_lease_order", "O1", f"""WITH {LEASE} SELECT strftime(date, '%Y-%m-%d') AS date, area, floor, deposit, kind, row_number() OVER (ORDER BY date, area, coalesce(floor, -999), deposit, kind, complex_id, period) AS line FROM lease""")
def canonical_lease_order(star):
    order = [F.col("date"), F.col("area"), F.coalesce("floor", F.lit(-999)), F.col("deposit"), F.col("kind"), F.col("complex_id"), F.col("period")]
    return number_rows(star.leases, *order, name="line").select(F.col("date").cast("string").alias("date"), "area", "floor", "deposit", "kind", "line")


@query("canonical_complex_order", "O2", f"""WITH {COMPLEX} SELECT complex_id, row_number() OVER (ORDER BY region, complex_id) AS line, row_number() OVER (ORDER BY legal_dong, name) AS dong_line FROM complex""")
def canonical_complex_order(star):
    a = number_rows(star.complexes.select("complex_id", "region"), F.col("region"), F.col("complex_id"), name="line")
    b = number_rows(star.complexes.select("complex_id", "legal_dong", "name"), F.col("legal_dong"), F.col("name"), name="dong_line")
    return a.join(b, "complex_id").select("complex_id", "line", "dong_line")


@query("region_month_counts", "A1", f"""WITH {SALE}, {COMPLEX} SELECT region, ym, count(*) AS n FROM sale JOIN complex USING (complex_id) GROUP BY 1, 2""")
def region_month_counts(star):
    joined = star.sales.select("complex_id", "ym").join(star.complexes.select("complex_id", "region"), "complex_id")
    return cv.month_counts(joined, "region").withColumnRenamed("rows", "n")


@query("region_coverage", "A2 K4", f"""WITH {SALE}, {LEASE}, {COMPLEX}, c AS (SELECT complex_id, region, far, (SELECT count(*) FROM sale s WHERE s.complex_id = c.complex_id) AS sales, (SELECT count(*) FROM lease l WHERE l.complex_id = c.complex_id) AS leases FROM complex c)
SELECT region, count(*) AS complexes, CAST(sum(sales) AS BIGINT) AS sale_rows, CAST(sum(leases) AS BIGINT) AS lease_rows, count(far) AS far_verified, count(*) FILTER (sales = 0) AS unresolved FROM c GROUP BY ROLLUP (region)""")
def region_coverage(star):
    sold = star.sales.select("complex_id").distinct().withColumn("_s", F.lit(True))
    c = star.complexes.join(sold, "complex_id", "left").select(
        "complex_id", "region", F.when(F.col("far").isNotNull(), "verified").otherwise("unconfirmed").alias("far_status"),
        F.when(F.col("_s"), "collected").otherwise("matching_unconfirmed").alias("data_status"),
    )
    return cv.region_coverage(c, star.sales, star.leases)


@query("observed_top_floors", "A12", f"""WITH {SALE}, {COMPLEX} SELECT complex_id, CASE WHEN far IS NOT NULL THEN 30 ELSE max(floor) END AS top_floor FROM complex LEFT JOIN sale USING (complex_id) GROUP BY complex_id, far""")
def observed_top_floors(star):
    c = star.complexes.withColumn("top_floor", F.when(F.col("far").isNotNull(), 30))
    return cv.top_floors(c, star.sales).select("complex_id", "top_floor")


@query("part_stats", "A15", f"""WITH {SALE}, {COMPLEX}, p AS (SELECT region, min(ym) AS min_month, max(ym) AS current_month, count(DISTINCT complex_id) AS c, count(*) AS t FROM sale JOIN complex USING (complex_id) GROUP BY 1)
SELECT count(*) AS parts, min(min_month) AS min_month, max(current_month) AS current_month, CAST(sum(c) AS BIGINT) AS complexes, CAST(sum(t) AS BIGINT) AS transactions FROM p""")
def part_stats(star):
    joined = star.sales.select("complex_id", "ym").join(star.complexes.select("complex_id", "region"), "complex_id")
    parts = joined.groupBy("region").agg(
        F.min("ym").alias("min_month"), F.max("ym").alias("current_month"), F.count_distinct("complex_id").alias("complex_count"), F.count("*").alias("transaction_count")
    )
    return cv.part_stats(parts)


@query("attribute_conflicts", "A5", """SELECT p_name, count(*) AS n, CAST(count(DISTINCT p_type || '|' || p_size) > 1 AS INT) AS conflict FROM part GROUP BY 1""")
def attribute_conflicts(star):
    out = cv.attribute_conflicts(star.table("part"), "p_name", ["p_type", "p_size"])
    return out.select("p_name", F.col("rows").alias("n"), F.col("conflict").cast("int").alias("conflict"))


@query("status_histogram", "A16", """SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1""")
def status_histogram(star):
    return cv.status_histogram(star.table("orders"), "o_orderstatus")


_STATUS, _PRIORITY = "o_orderstatus", "o_orderpriority"


@query("merged_documents", "J19 O3", f"""WITH {THREE.replace('o_orderkey AS path', 'o_custkey, o_orderkey AS path')}, j AS (SELECT o_custkey, path, b.value AS b, l.value AS l, r.value AS r FROM b FULL JOIN l USING (o_custkey, path) FULL JOIN r USING (o_custkey, path)),
w AS (SELECT *, bool_and(b IS NOT DISTINCT FROM l) OVER g AS local_same, bool_and(b IS NOT DISTINCT FROM r) OVER g AS remote_same, count(l) OVER g AS locals FROM j WINDOW g AS (PARTITION BY o_custkey)),
m AS (SELECT *, CASE WHEN local_same THEN r WHEN remote_same THEN l WHEN b IS NOT DISTINCT FROM l THEN r ELSE l END AS v FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY path DESC) AS n FROM m WHERE v IS NOT NULL),
k AS (SELECT o_custkey, string_agg(path || ':' || v, ',' ORDER BY path) AS presets FROM n WHERE local_same OR remote_same OR locals = 0 OR n <= 10 GROUP BY 1)
SELECT o_custkey, coalesce(presets, '') AS presets FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN k USING (o_custkey)""")
def merged_documents(star):
    """Each customer's document of saved orders on three devices: merged place by place, lists cut to the newest ten inside."""
    o, p, s = star.table("orders"), F.col(_PRIORITY), F.col(_STATUS)
    early = F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz")
    sides = {
        "base": (p != "4-NOT SPECIFIED", s),
        "local": (p != "2-HIGH", F.when(p == "1-URGENT", "local").otherwise(s)),
        "remote": ((p != "4-NOT SPECIFIED") & early, F.when(s == "F", "remote").otherwise(s)),
    }

    def document(there, note):
        item = F.struct(F.col("o_orderkey").alias("savedAt"), F.col("o_orderkey").cast("string").alias("id"), F.lit(True).alias("preset"), note.alias("note"))
        listed = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.when(there, item))).alias("presets"))
        return listed.select("o_custkey", F.to_json(F.struct(F.struct("presets").alias("storage"))).alias("value"))

    merged = tr.merge_documents(*(document(*x) for x in sides.values()), ["o_custkey"])
    kept = F.from_json("value", "struct<storage:struct<presets:array<struct<id:string,note:string>>>>")["storage"]["presets"]
    return merged.select("o_custkey", F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["id"], x["note"])), ",").alias("presets"))
