"""Data-quality rules over the test tables: each query lists what breaks the rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from hanok.functions.months import ym_of_date
from hanok.operators import cascade as cs
from hanok.operators import guards as g
from hanok.operators import linking as ln
from hanok.registry import query
from hanok.starmap import COMPLEX, LEASE, RAW_SALE, SALE, TRADE

GUARD = '"guard"'


def _floors(star, least):
    return star.table("nation").select(F.col("n_name").alias("region"), F.lit(least).alias("least"))


@query("guard_minimum_rows", "G1 G20", f"""WITH {COMPLEX}, n AS (SELECT n_name AS region, count(complex_id) AS n FROM nation LEFT JOIN complex ON n_name = region GROUP BY 1)
SELECT 'too_few_rows' AS {GUARD}, region AS key, '' || n AS detail FROM n WHERE n < 4 UNION ALL SELECT 'too_few_sales', 'all', '' || count(*) FROM lineitem HAVING count(*) < 1000000000""")
def guard_minimum_rows(star):
    return g.all_of(
        g.minimum_rows_by(star.complexes, "region", _floors(star, 4)), g.minimum_rows(star.table("lineitem"), 1_000_000_000, "too_few_sales")
    )


@query("guard_scope", "G2", f"""WITH {COMPLEX} SELECT 'outside_scope' AS {GUARD}, region AS key, '' || count(*) AS detail FROM complex WHERE province = 'ASIA' GROUP BY region""")
def guard_scope(star):
    allowed = star.table("nation").join(star.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).filter("r_name <> 'ASIA'")
    return g.outside_scope(star.complexes, "region", allowed.select(F.col("n_name").alias("region")))


@query("guard_missing_months", "G3", f"""WITH {SALE}, {COMPLEX}, have AS (SELECT DISTINCT region, ym FROM sale JOIN complex USING (complex_id) WHERE floor >= 18),
want AS (SELECT n_name AS region, strftime(m, '%Y-%m') AS ym FROM nation, (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-11-01', INTERVAL 1 MONTH)) AS m))
SELECT 'missing_month' AS {GUARD}, region AS key, ym AS detail FROM want WHERE (region, ym) NOT IN (SELECT region, ym FROM have)""")
def guard_missing_months(star):
    rows = star.sales.filter("floor >= 18").join(star.complexes.select("complex_id", "region"), "complex_id")
    groups = star.table("nation").select(F.col("n_name").alias("region"))
    return g.missing_months(rows, "region", groups, "1995-01", "2001-11")


@query("guard_collapsed", "G4", f"""WITH {TRADE}, b AS (SELECT complex_id, count(*) AS n FROM trade WHERE ym BETWEEN '1996-01' AND '1998-12' GROUP BY 1),
a AS (SELECT complex_id, count(*) AS n FROM trade WHERE ym BETWEEN '1996-01' AND '1998-12' AND floor >= 12 GROUP BY 1)
SELECT 'trades_collapsed' AS {GUARD}, '' || complex_id AS key, b.n || '->' || coalesce(a.n, 0) AS detail FROM b LEFT JOIN a USING (complex_id) WHERE b.n >= 10 AND coalesce(a.n, 0) < b.n * 0.5""")
def guard_collapsed(star):
    return g.collapsed(star.trades, star.trades.filter("floor >= 12"), "complex_id", "1996-01", "1998-12")


@query("guard_shrunk_catalogue", "G5", f"""WITH {COMPLEX}, n AS (SELECT n_name AS region, count(complex_id) AS p, count(complex_id) FILTER (far > 200) AS n FROM nation LEFT JOIN complex ON n_name = region GROUP BY 1)
SELECT 'catalogue_shrunk' AS {GUARD}, region AS key, n || '<' || greatest(2, CAST(floor(p * 0.8) AS BIGINT)) AS detail FROM n WHERE n < greatest(2, floor(p * 0.8))""")
def guard_shrunk_catalogue(star):
    return g.shrunk(star.complexes, star.complexes.filter("far > 200"), "region", _floors(star, 2))


@query("guard_duplicates", "G6 G15", f"""SELECT 'duplicate_key' AS {GUARD}, l_orderkey || '|' || l_linenumber AS key, '' || count(*) AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def guard_duplicates(star):
    return g.duplicated(star.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("guard_invalid_complexes", "G7 G11", f"""WITH {COMPLEX} SELECT 'invalid_complex' AS {GUARD}, '' || complex_id AS key, CASE WHEN households = 500 THEN region ELSE region || '/' || households END AS detail FROM complex
WHERE province = 'AFRICA' OR households < 300 OR households = 500""")
def guard_invalid_complexes(star):
    regions = star.complexes.filter("province <> 'AFRICA'").select("region").distinct()
    c = star.complexes.withColumn("households", F.when(F.col("households") != 500, F.col("households")))  # 500 plays the unknown size
    return g.invalid_complexes(c, regions, 300)


@query("guard_invalid_trades", "G8 G11 F5", f"""SELECT 'invalid_trade' AS {GUARD}, '' || l_suppkey AS key, concat_ws('/', CASE WHEN l_returnflag <> 'A' THEN strftime(l_shipdate, '%Y-%m-%d') END, CASE WHEN l_quantity < 50 THEN '' || l_quantity ELSE '0.0' END, '' || l_linenumber,
  '' || CAST(floor(l_extendedprice) - 2000 AS BIGINT)) AS detail FROM lineitem WHERE l_returnflag = 'A' OR l_quantity >= 50 OR floor(l_extendedprice) <= 2000""")
def guard_invalid_trades(star):
    li = star.table("lineitem").select(
        F.col("l_suppkey").alias("complex_id"), F.when(F.col("l_returnflag") != "A", F.col("l_shipdate").cast("date")).alias("date"),
        F.when(F.col("l_quantity") < 50, F.col("l_quantity")).otherwise(0.0).alias("area"), F.col("l_linenumber").alias("floor"),
        (F.floor("l_extendedprice") - 2000).alias("price"),
    )
    return g.invalid_trades(li)


@query("guard_sale_rows", "G2 G8 G9", f"""WITH {RAW_SALE} SELECT 'outside_district' AS {GUARD}, cgg_cd AS key, '' || count(*) AS detail FROM raw_sale WHERE cgg_cd IN (SELECT n_name FROM nation WHERE n_regionkey = 1) GROUP BY 2""")
def guard_sale_rows(star):
    districts = star.table("nation").filter("n_regionkey <> 1").select(F.col("n_name").alias("cgg_cd"), F.col("n_name").alias("region"))
    rows = ln.sale_rows(star.raw_sales(), districts)
    linked = ln.linked_sales(rows, star.bindings, star.catalogue, "1995-01", "2001-12")
    return ln.sale_guards(rows, linked, star.catalogue, districts)


@query("guard_bindings", "J1 G9", f"""WITH {COMPLEX} SELECT 'binding_conflict' AS {GUARD}, '' || complex_id AS key, legal_dong || '/' || (build_year - 3) AS detail FROM complex WHERE households >= 500 AND province = 'EUROPE'""")
def guard_bindings(star):
    drifted = star.bindings.join(star.complexes.select("complex_id", "province"), "complex_id").withColumn(
        "build_year", F.when(F.col("province") == "EUROPE", F.col("build_year") - 3).otherwise(F.col("build_year"))
    ).drop("province")
    return ln.binding_conflicts(drifted, star.catalogue)


@query("guard_region_mismatch", "G9", f"""WITH {TRADE}, {COMPLEX}, t AS (SELECT complex_id, n_name AS region, count(*) AS n FROM trade JOIN nation ON floor = n_nationkey GROUP BY 1, 2)
SELECT 'region_mismatch' AS {GUARD}, '' || complex_id AS key, t.region || '/' || c.region || '/' || n AS detail FROM t JOIN complex c USING (complex_id) WHERE t.region <> c.region""")
def guard_region_mismatch(star):
    n = star.table("nation").select(F.col("n_nationkey").alias("floor"), F.col("n_name").alias("region"))
    return g.region_mismatch(star.trades.join(n, "floor"), star.complexes)


@query("guard_nothing_linked", "G10", f"""WITH {COMPLEX} SELECT 'nothing_linked' AS {GUARD}, n_name AS key, '' AS detail FROM nation WHERE n_name NOT IN (SELECT region FROM complex WHERE far > 700)""")
def guard_nothing_linked(star):
    return g.nothing_linked(star.complexes.filter("far > 700"), "region", star.table("nation").select(F.col("n_name").alias("region")))


@query("guard_totals", "G12", f"""WITH {SALE}, {LEASE}, s(name, stated) AS (VALUES ('sales', 1), ('leases', 2), ('complexes', -1)),
c AS (SELECT 'sales' AS name, count(*) AS n FROM sale UNION ALL SELECT 'leases', count(*) FROM lease UNION ALL SELECT 'complexes', count(*) FROM supplier)
SELECT 'total_differs' AS {GUARD}, name AS key, stated || '<>' || n AS detail FROM s JOIN c USING (name)""")
def guard_totals(star):
    def n(df, name):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")

    counted = n(star.sales, "sales").unionByName(n(star.leases, "leases")).unionByName(n(star.complexes, "complexes"))
    return g.totals_differ(star.spark, {"sales": 1, "leases": 2, "complexes": -1}, counted)


@query("guard_ratio_status", "G12", f"""WITH {COMPLEX} SELECT 'ratio_status' AS {GUARD}, '' || complex_id AS key, concat_ws('/', CASE WHEN province = 'ASIA' THEN 'verified' ELSE 'unconfirmed' END, '' || far) AS detail FROM complex
WHERE CASE WHEN province = 'ASIA' THEN far IS NULL ELSE far IS NOT NULL END""")
def guard_ratio_status(star):
    c = star.complexes.withColumn("far_status", F.when(F.col("province") == "ASIA", "verified").otherwise("unconfirmed"))
    return g.ratio_status(c)


@query("guard_lease_shape", "G12", f"""WITH {LEASE} SELECT 'lease_shape' AS {GUARD}, '' || complex_id AS key, concat_ws('/', ym, '' || area, '' || deposit, '' || floor) AS detail FROM lease WHERE ym NOT BETWEEN '1995-03' AND '2001-09'""")
def guard_lease_shape(star):
    return g.lease_shape(star.leases, "1995-03", "2001-09")


@query("guard_region_parts", "G16", f"""SELECT 'region_part' AS {GUARD}, n_name AS key, '' || CASE WHEN n_regionkey = 4 THEN 0 ELSE 1 END AS detail FROM nation WHERE n_regionkey IN (0, 3, 4)""")
def guard_region_parts(star):
    n = star.table("nation")
    parts = n.filter("n_regionkey <> 4").select(
        F.col("n_name").alias("region"), F.lit(6).alias("months_requested"), F.when(F.col("n_regionkey") == 3, 5).otherwise(6).alias("months_succeeded")
    )
    return g.parts_incomplete(parts, n.filter("n_regionkey <> 0").select(F.col("n_name").alias("region")))


@query("guard_walks", "G18", f"""SELECT 'walk_out_of_range' AS {GUARD}, '' || o_orderkey AS key, o_orderpriority || '/' || CAST(floor(o_totalprice / 300) AS BIGINT) || '/' || round(floor(o_totalprice / 300) / 64, 4) AS detail FROM orders WHERE floor(o_totalprice / 300) > 1280""")
def guard_walks(star):
    metres = F.floor(F.col("o_totalprice") / 300)
    walks = star.table("orders").select(
        F.col("o_orderkey").alias("complex_id"), F.col("o_orderpriority").alias("station"), metres.alias("distance_m"),
        F.round(metres / 64, 4).alias("minutes"), F.array(F.lit("2")).alias("lines"),
    )
    return g.walk_out_of_range(walks)


@query("guard_linked_share", "G18 G14", f"""WITH {COMPLEX}, c AS (SELECT count(*) AS p, count(*) FILTER (far > 300) AS n FROM complex)
SELECT 'linked_share' AS {GUARD}, 'all' AS key, p || '->' || n AS detail FROM c WHERE n < p * 0.85 UNION ALL SELECT 'absent', '' || complex_id, '' FROM complex WHERE far IS NULL OR far <= 300""")
def guard_linked_share(star):
    now = star.complexes.filter("far > 300")
    return g.all_of(g.linked_share(star.complexes, now, "complex_id"), g.absent(star.complexes, now, "complex_id"))


@query("guard_responses", "G19 P12", f"""SELECT 'response_mismatch' AS {GUARD}, c || '/' || d || '/' || y AS key, c || '/' || d || '/' || strftime(l_shipdate, '%Y-%m-%d') AS detail
FROM (SELECT *, '41' || lpad('' || s_nationkey, 3, '0') AS c, '10' || lpad('' || (l_suppkey % 3), 3, '0') AS d, CASE WHEN l_linenumber = 2 THEN 1990 ELSE year(l_shipdate) END AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) WHERE l_linenumber = 2""")
def guard_responses(star):
    wrong = star.responses().withColumn("A11", F.when(F.substring("KAB_APTNM", 1, 4) == "the ", F.concat(F.col("year").cast("string"), F.lit("."), F.col("A11"))).otherwise(F.col("A11")))
    wrong = wrong.withColumn("B11", F.when(F.substring("KAB_APTNM", 1, 4) == "the ", F.concat(F.col("year").cast("string"), F.lit("."), F.col("B11"))).otherwise(F.col("B11")))
    wrong = wrong.withColumn("year", F.when(F.substring("KAB_APTNM", 1, 4) == "the ", 1990).otherwise(F.col("year")))
    return g.response_mismatch(cs.contracts(wrong))


@query("guard_ledger", "G17", f"""WITH {COMPLEX} SELECT 'ledger_rows' AS {GUARD}, 'all' AS key, '' || count(*) AS detail FROM complex WHERE region = 'NATION_9' HAVING count(*) < 100
UNION ALL SELECT 'no_verified_ratio', 'NATION_9', '0'""")
def guard_ledger(star):
    ledger = star.complexes.withColumn("district", F.col("region"))
    return g.ledger_coverage(ledger, "NATION_9", star.complexes.withColumn("far_status", F.lit("unconfirmed")), verified_before=True)


@query("guard_period", "C5 D10", f"""WITH m AS (SELECT c_custkey, max(strftime(o_orderdate, '%Y-%m')) AS current_month FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT 'period_pending' AS {GUARD}, '' || c_custkey AS key, current_month AS detail FROM m WHERE '2001-05' > current_month UNION ALL SELECT 'not_fresh', '' || c_custkey, current_month FROM m WHERE current_month <> '2001-07'""")
def guard_period(star):
    m = star.table("orders").groupBy(F.col("o_custkey").alias("provider")).agg(F.max(ym_of_date("o_orderdate")).alias("current_month"))
    return g.all_of(g.period_pending(m, "2001-05"), g.not_fresh(m, "2001-07"))
