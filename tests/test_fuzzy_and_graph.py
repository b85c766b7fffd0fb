import heapq
import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from hanok.operators import fuzzy, graph, spatial, stations
from hanok.operators import guards as g
from hanok.operators.enrich import apply_transport
from hanok.plans import transport
from hanok.session import cut, settled


def plain_score(c, t):
    a, b = c["name"], t["raw_name"]
    base = 1.0 if a == b else 0.92 if a in b or b in a else SequenceMatcher(None, a, b).ratio()
    diff = abs(c["build_year"] - t["build_year"])
    base += 0.05 if diff == 0 else 0.02 if diff <= 2 else -0.12 if diff >= 7 else 0
    x, y = t["legal_dong"], c["legal_dong"]
    return base + (0.04 if x == y else -0.04 if x not in y and y not in x else 0)


def test_best_match_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["한솔", "푸른", "마을", "주공", "래미안", "자이", "힐스", "테이트", "sk", "뷰", "1", "2", "단지", "그린"]
    make = lambda: "".join(rng.choices(words, k=rng.randint(1, 4)))
    catalog = [dict(complex_id=i, region=rng.choice("xy"), name=make(), build_year=rng.choice([1990, 1992, 2000]), legal_dong=rng.choice(["가동", "가", "나동"]), ord=i) for i in range(150)]
    trades, seen = [], set()
    for _ in range(400):
        name = make() if rng.random() < 0.4 else rng.choice(catalog)["name"]
        if rng.random() < 0.5:
            at = rng.randrange(len(name) + 1)
            name = name[:at] + rng.choice(["", "a", "동", "차"]) + name[at + rng.randint(0, 1):]
        t = dict(region=rng.choice("xy"), raw_name=name, build_year=rng.choice([1990, 1991, 1999, 2010]), legal_dong=rng.choice(["가동", "나동"]))
        k = tuple(t.values())
        if name and k not in seen:
            seen.add(k)
            trades.append(t)
    want = {}
    for t in trades:
        pool = [c for c in catalog if c["region"] == t["region"]]
        equal = [c for c in pool if c["name"] == t["raw_name"]]
        scored = [(plain_score(c, t), -c["ord"], c["complex_id"]) for c in (equal or pool)]
        best = max(scored)
        want[tuple(t.values())] = best[2] if best[0] >= (0.74 if equal else 0.80) else None
    ks = spark.createDataFrame([tuple(t.values()) for t in trades], "region string, raw_name string, build_year int, legal_dong string")
    cs = spark.createDataFrame([tuple(c.values()) for c in catalog], "complex_id int, region string, name string, build_year int, legal_dong string, ord int")
    got = {(r.region, r.raw_name, r.build_year, r.legal_dong): r.complex_id for r in fuzzy.best_match(ks, cs).collect()}
    assert got == want
    assert sum(v is not None for v in want.values()) > 100 and sum(v is None for v in want.values()) > 30


def test_ratio_is_taken_from_the_catalogue_name(spark):
    # the ratio is not symmetric: 0.6 from the catalogue's side, 0.8 from the trade's
    one, two = "나다바바바", "나바바다바"
    assert SequenceMatcher(None, one, two).ratio() < 0.7 < SequenceMatcher(None, two, one).ratio()
    keys = spark.createDataFrame([("x", two, 2000, "가동"), ("y", one, 2000, "가동")], "region string, raw_name string, build_year int, legal_dong string")
    catalogue = spark.createDataFrame([(1, "x", one, 2000, "가동", 0), (2, "y", two, 2000, "가동", 0)], "complex_id int, region string, name string, build_year int, legal_dong string, ord int")
    assert {r.region: r.complex_id for r in fuzzy.best_match(keys, catalogue).collect()} == {"x": None, "y": 2}


def odd_score(c, t):
    base = 1.0 if c["name"] == t["raw_name"] else 0.92 if c["name"] in t["raw_name"] or t["raw_name"] in c["name"] else SequenceMatcher(None, c["name"], t["raw_name"]).ratio()
    if c["build_year"] and t["build_year"]:
        gap = abs(c["build_year"] - t["build_year"])
        base = base + (0.05 if gap == 0 else 0.02 if gap <= 2 else -0.12 if gap >= 7 else 0.0)
    x, y = ((r["legal_dong"] or "").strip(" ") for r in (t, c))
    return base + (0.0 if not x or not y else 0.04 if x == y else -0.04 if x not in y and y not in x else 0.0)


def test_best_match_with_unknown_years_and_dongs_within_others(spark):
    rng = random.Random(7)
    years, dongs = [None, 0, 3, *range(1988, 2012)], [None, "", " ", "가", "가동", " 가동 ", "나", "가나동", "*", "-", "=가"]
    names = ["abcdefgh", "abcdefgx", "abcd", "zzzz", "zzzy"]
    row = lambda name: dict(name=name, build_year=rng.choice(years), legal_dong=rng.choice(dongs))
    catalog = [dict(complex_id=1000 - i, ord=rng.choice([i, i // 3])) | row(rng.choice(names[:4])) for i in range(60)]
    trades = {tuple(row(rng.choice(names)).values()) for _ in range(400)}
    # of rows that look the same the first counts, of equally good others with the same place the larger complex_id
    looks = {}
    for c in catalog:
        at = (c["name"], c["build_year"], c["legal_dong"])
        looks[at] = min(looks.get(at, c), c, key=lambda c: (c["ord"], c["complex_id"]))
    want = {}
    for name, year, dong in trades:
        t = dict(raw_name=name, build_year=year, legal_dong=dong)
        equal = [c for c in looks.values() if c["name"] == name]
        best = max((odd_score(c, t), -c["ord"], c["complex_id"]) for c in equal or looks.values())
        known = year is not None and dong is not None  # null years and dongs never find their own row again
        want[name, year, dong] = best[::2] if known and best[0] >= (0.74 if equal else 0.80) else (None, None)
    ks = spark.createDataFrame([("x", *t) for t in trades], "region string, raw_name string, build_year int, legal_dong string")
    cs = spark.createDataFrame([("x", *(c[f] for f in ("complex_id", "name", "build_year", "legal_dong", "ord"))) for c in catalog], "region string, complex_id int, name string, build_year int, legal_dong string, ord int")
    got = {(r.raw_name, r.build_year, r.legal_dong): (r.score, r.complex_id) for r in fuzzy.best_match(ks, cs).collect()}
    assert got == want
    assert 50 < sum(v[0] is not None for v in want.values()) < len(want)


def made(node):
    """Rows of every step of a plan that has run."""
    kind = node.nodeName()
    if kind.startswith("AdaptiveSparkPlan"):
        return made(node.executedPlan())
    if "QueryStage" in kind:
        return made(node.plan())
    rows = node.metrics().get("numOutputRows")
    own = [rows.get().value()] if rows.isDefined() else []
    return own + [n for i in range(node.children().size()) for n in made(node.children().apply(i))]


def test_keys_and_complexes_of_one_name_do_not_meet_in_pairs(spark):
    n = 600
    places = [(1900 + i % 120, f"{'abcdefghij'[i % 10]}{i}동") for i in range(n)]
    ks = spark.createDataFrame([("x", "한솔마을", *p) for p in places], "region string, raw_name string, build_year int, legal_dong string")
    cs = spark.createDataFrame([(i, "x", "한솔마을", *p, i) for i, p in enumerate(places)], "complex_id int, region string, name string, build_year int, legal_dong string, ord int")
    matched = fuzzy.best_match(ks, cs)
    assert {(r.build_year, r.legal_dong): r.complex_id for r in matched.collect()} == {p: i for i, p in enumerate(places)}
    assert max(made(matched._jdf.queryExecution().executedPlan())) < n * n / 4


def street_grid(n=8, step=100.0):
    nodes = {(i, j): (i * n + j, i * step, j * step * 1.1) for i in range(n) for j in range(n)}
    ways = []
    for i in range(n):
        ways.append([nodes[(i, j)] for j in range(n)])
        ways.append([nodes[(j, i)] for j in range(n)][: n - (i % 3)])
    return list(nodes.values()), ways


def plain_edges(ways):
    edges = {}
    for w in ways:
        for a, b in zip(w, w[1:]):
            edges.setdefault(tuple(sorted((a[0], b[0]))), math.dist(a[1:], b[1:]))
    return edges


def way_table(spark, ways):
    return spark.createDataFrame([(i, w) for i, w in enumerate(ways)], "way_id bigint, nodes array<struct<id:bigint,x:double,y:double>>")


def test_snap_and_paths_equal_brute_force(spark):
    rng = random.Random(5)
    nodes, ways = street_grid()
    where = {n[0]: n[1:] for n in nodes}
    edges = plain_edges(ways)
    edge_df = spatial.way_edges(way_table(spark, ways))
    assert {(r.a, r.b): r.length for r in edge_df.collect()} == pytest.approx(edges)

    houses = [(i, rng.uniform(-200, 900), rng.uniform(-200, 1000)) for i in range(60)] + [(100, 50.0, 1.0), (101, 50.0, 1.0)]
    got = {r.id: r for r in spatial.snap(spark.createDataFrame(houses, "id bigint, x double, y double"), edge_df, 150).collect()}

    def nearest(x, y):
        best = None
        for (a, b), length in edges.items():
            (ax, ay), (bx, by) = where[a], where[b]
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / length**2))
            d = math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))
            best = min(best, d) if best is not None else d
        return best

    for i, x, y in houses:
        d = nearest(x, y)
        assert (i in got) == (d <= 150)
        if i in got:
            assert got[i].connector == pytest.approx(d)

    starts = [(i, a, d) for i, r in got.items() for a, d in ((r.a, r.to_a), (r.b, r.to_b))]
    paths = {(r.source, r.node): r.dist for r in graph.bounded_paths(spark.createDataFrame(starts, "source bigint, node bigint, dist double"), edge_df, 400.0, hops=2).collect()}
    around = {}
    for (a, b), length in edges.items():
        around.setdefault(a, []).append((b, length))
        around.setdefault(b, []).append((a, length))
    want = {}
    for source in got:
        best, heap = {}, [(d, n) for s, n, d in starts if s == source]
        heapq.heapify(heap)
        while heap:
            d, n = heapq.heappop(heap)
            if d > 400.0 or n in best:
                continue
            best[n] = d
            for m, length in around[n]:
                heapq.heappush(heap, (d + length, m))
        want.update({(source, n): d for n, d in best.items()})
    assert paths == pytest.approx(want)


def test_path_limit_is_closed(spark):
    edges = spark.createDataFrame([(1, 2, 100.0), (2, 3, 100.0), (3, 4, 0.5)], "a bigint, b bigint, length double")
    starts = spark.createDataFrame([("s", 1, 0.0)], "source string, node bigint, dist double")
    got = {r.node: (r.dist, r.prev) for r in graph.bounded_paths(starts, edges, 200.0).collect()}
    assert got == {1: (0.0, None), 2: (100.0, 1), 3: (200.0, 2)}


def test_connected_groups_close_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20], "a bigint, b bigint")
    nodes = spark.range(42)
    got = {r.id: r.group_id for r in graph.connected_groups(nodes, links).collect()}
    assert got == {i: 0 if i <= 20 else 21 if i <= 40 else 41 for i in range(42)}


def test_same_name_stations_merge_within_600_metres(spark):
    rows = [(1, "당산", 0.0, 0.0), (2, "당산", 500.0, 0.0), (3, "당산", 1000.0, 0.0), (4, "당산", 1700.0, 0.0), (5, "합정", 10.0, 0.0), (6, "당산", 1000.0, 599.9), (7, "당산", 1700.0, 600.0)]
    rows += [(100 + i, "같은곳", 5.0, 5.0) for i in range(300)]  # copies of one place are one member
    got = {r.id: r.group_id for r in spatial.merge_same_name(spark.createDataFrame(rows, "id bigint, name string, x double, y double")).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {1: 1, 2: 1, 3: 1, 6: 1, 4: 4, 5: 5, 7: 7}
    assert {v for k, v in got.items() if k >= 100} == {100}


def in_order(rows, limit=600.0):
    """Groups formed one point after the other, as a loop."""
    founders, got = [], {}
    for i, name, x, y, lon, lat in sorted(rows):
        spot = (name, round(lon, 2), round(lat, 2))
        near = [f for f in founders if f[1] == name and math.hypot(x - f[2], y - f[3]) < limit]
        near = near or [f for f in founders if f[4] == spot]
        if not near:
            founders.append((i, name, x, y, spot))
            near = founders[-1:]
        got[i] = near[0][0]
    return got


def placed_points(xy, names=("당산",)):
    return [(i, names[i % len(names)], x, y, 126.7001 + x / 88000.0, 37.0001 + y / 111000.0) for i, (x, y) in enumerate(xy)]


@pytest.mark.parametrize("shape", ["chain", "back", "crowd", "cell"])
def test_stations_merge_in_the_order_they_come(spark, shape):
    rng = random.Random(shape)
    if shape == "chain":  # every point waits for the one before it
        rows = placed_points([(i * 350.0, 0.0) for i in range(24)])
    elif shape == "back":
        rows = placed_points([((24 - i) * 550.0, i % 3 * 200.0) for i in range(24)])
    elif shape == "crowd":
        rows = placed_points([(rng.uniform(0, 5000), rng.uniform(0, 5000)) for _ in range(400)], ("당산", "합정", "서울"))
    else:  # far apart within one degree cell, with a later founder nearer than the cell's
        rows = placed_points([(10.0, 10.0), (800.0, 10.0), (800.0, 990.0), (400.0, 500.0), (1390.0, 500.0), (10.0, 10.0)])
    points = spark.createDataFrame(rows, "id bigint, name string, x double, y double, lon double, lat double")
    assert {r.id: r.group_id for r in spatial.merge_in_order(points).collect()} == in_order(rows)


def test_a_long_chain_of_stations_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(spatial, "settled", lambda df: written.append(1) or settled(df))
    rows = placed_points([(i * 350.0, i % 2 * 90.0) for i in range(300)], ("당산", "합정"))
    points = spark.createDataFrame(rows, "id bigint, name string, x double, y double, lon double, lat double")
    assert {r.id: r.group_id for r in spatial.merge_in_order(points).collect()} == in_order(rows)
    assert len(written) <= 5


def test_stations_merge_in_order_over_several_blocks(spark):
    rng = random.Random(4)
    rows = placed_points([(rng.uniform(0, 4000), rng.uniform(0, 4000)) for _ in range(200)], ("당산", "합정"))
    points = spark.createDataFrame(rows, "id bigint, name string, x double, y double, lon double, lat double")
    assert {r.id: r.group_id for r in spatial.merge_in_order(points, block=40).collect()} == in_order(rows)


def most_rows(df):
    """The most rows that a step of the executed plan gives."""
    df.collect()

    def most(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return most(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return most(p.plan())
        own = p.metrics().get("numOutputRows")
        below = [most(p.children().apply(i)) for i in range(p.children().size())]
        return max([own.get().value() if own.isDefined() else 0, *below])

    return most(df._jdf.queryExecution().executedPlan())


def test_areas_and_stations_of_one_name_do_not_meet_in_pairs(spark):
    n = 300
    tags = F.create_map(F.lit("railway"), F.when(F.col("id") < n, "station").otherwise("subway_entrance"), F.lit("name"), F.lit("당산역"), F.lit("line"), F.when(F.col("id") % 7 == 0, "2호선").otherwise(""))
    nodes = spark.range(2 * n).select("id", F.lit(126.9).alias("lon"), F.lit(37.5).alias("lat"), tags.alias("tags"))
    member = F.array(*[F.struct(F.lit("n").alias("type"), r.alias("ref"), F.lit("").alias("role")) for r in (F.col("id"), F.col("id") + n)])
    areas = spark.range(n).select("id", F.create_map(F.lit("public_transport"), F.lit("stop_area"), F.lit("name"), F.lit("당산역")).alias("tags"), member.alias("members"))
    lines = stations.station_lines(nodes, areas)
    assert {(r.id, *r.lines) for r in lines.collect()} == {(i, "2") for i in range(n)}
    assert most_rows(lines) < 10 * n
    heads = stations.station_nodes(nodes).filter(F.col("id") < n).select("id", "name", F.lit(0).cast("bigint").alias("group_id"))
    gates = stations.entrances(heads, nodes, areas)
    assert {(r.group_id, r.endpoint, r.how) for r in gates.collect()} == {(0, n + i, "area") for i in range(n)}
    assert most_rows(gates) < 10 * n


def test_points_without_a_place_are_groups_of_their_own(spark):
    schema = "id bigint, name string, x double, y double, lon double, lat double"
    points = spark.createDataFrame([(1, "당산", None, 1.0, None, 37.0), (2, "당산", 1.0, 1.0, 126.9, 37.0), (3, "당산", 2.0, 1.0, 126.9, 37.0), (4, None, 1.0, 1.0, 126.9, 37.0)], schema)
    assert {r.id: r.group_id for r in spatial.merge_in_order(points).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    assert spatial.merge_in_order(points.limit(0)).count() == 0


def test_sources_that_share_an_entry_share_its_walk(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(graph, "cut", lambda df: sizes.append(df.count()) or cut(df))
    edges = spark.createDataFrame([(i, i + 1, 10.0) for i in range(20)], "a bigint, b bigint, length double")
    starts = spark.createDataFrame([(s, n, s + 5.0 * n) for s in range(60) for n in (0, 1)], "source bigint, node bigint, dist double")
    got = {(r.source, r.node): r.dist for r in graph.bounded_paths(starts, edges, 100.0).collect()}
    assert got == {(s, n): s + (10.0 * n - 5.0 if n else 0.0) for s in range(60) for n in range(21) if s + (10.0 * n - 5.0 if n else 0.0) <= 100}
    steps, entry, *rounds, whole = sizes
    assert whole == len(got) and max(rounds) <= 2 * 21


def test_routes_are_whole_paths_of_the_stated_length(spark):
    rng = random.Random(11)
    edges = {}
    for _ in range(260):
        a, b = sorted(rng.sample(range(90), 2))
        edges[a, b] = round(rng.uniform(10, 120), 1)
    edges.update({(200 + i, 201 + i): 3.0 for i in range(50)})  # a long chain: 50 steps back
    table = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a bigint, b bigint, length double")
    starts = spark.createDataFrame([("s", 1, 5.0), ("s", 2, 9.0), ("t", 200, 0.0)], "source string, node bigint, dist double")
    paths = graph.bounded_paths(starts, table, 300.0).cache()
    goals = paths.select("source", F.col("node").alias("goal"), "node")
    got = graph.routes(paths, goals).collect()
    want = {(r.source, r.node): r.dist for r in paths.collect()}
    first = {("s", 1): 5.0, ("s", 2): 9.0, ("t", 200): 0.0}
    assert len(got) == len(want) and len(next(r.nodes for r in got if r.goal == 250)) == 51
    for r in got:
        length = first[r.source, r.nodes[0]] + sum(edges[min(p), max(p)] for p in zip(r.nodes, r.nodes[1:], strict=False))
        assert r.nodes[-1] == r.goal and length == pytest.approx(want[r.source, r.goal])


def test_walk_guards(spark):
    c = spark.createDataFrame([("A1",), ("A2",)], "complex_id string")
    links = spark.createDataFrame([("A1", "linked")], "complex_id string, status string")
    walks = spark.createDataFrame([("A1", "당산역", ["2", "9"], 1301, 20.0)], "complex_id string, station string, lines array<string>, distance_m bigint, minutes double")
    out, broken = apply_transport(c, links, walks)
    assert {(r.guard, r.key) for r in broken.collect()} == {("walk_out_of_range", "A1"), ("link_row_absent", "A2")}
    r = out.filter("complex_id = 'A1'").first()
    assert (r.station, r.station_display, r.station_distance_km) == ("당산", "2,9당산", 1.301)
    assert g.linked_share(spark.range(100).withColumnRenamed("id", "complex_id"), spark.range(84).withColumnRenamed("id", "complex_id"), "complex_id").count() == 1


def test_station_links_end_to_end(spark):
    lon0, lat0 = transport.CENTRE
    m_lon, m_lat = 1 / 88400.0, 1 / 111195.0

    def at(x, y):
        return lon0 + x * m_lon, lat0 + y * m_lat

    corner = {i: at(i * 100.0, 0.0) for i in range(15)}
    ways = spark.createDataFrame(
        [(1, [(i, *corner[i]) for i in range(15)], {"highway": "footway"}), (2, [(0, *corner[0]), (99, *at(0, 100.0))], {"highway": "motorway"})],
        "way_id bigint, nodes array<struct<id:bigint,lon:double,lat:double>>, tags map<string,string>",
    )
    nodes = spark.createDataFrame(
        [
            (500, *at(700, 20), {"railway": "station", "name": "당산역"}),
            (501, *at(610, 10), {"railway": "subway_entrance", "name": "당산역 1번 출구"}),
            (502, *at(1400, 10), {"railway": "station", "name": "합정역", "line": "6호선"}),
            (503, *at(300, 10), {"railway": "station", "name": "폐역", "disused": "yes", "line": "1호선"}),
        ],
        "id bigint, lon double, lat double, tags map<string,string>",
    )
    relations = spark.createDataFrame(
        [(9, {"route": "subway", "name": "서울 지하철 2호선"}, [("n", 500, "")])],
        "id bigint, tags map<string,string>, members array<struct<type:string,ref:bigint,role:string>>",
    )
    c = spark.createDataFrame([("near", *at(0, 20)), ("far", *at(-1000, 20)), ("none", None, None)], "complex_id string, lon double, lat double")
    official = spark.createDataFrame([("near", *at(10, 20))], "complex_id string, lon double, lat double")
    out = transport.link_stations(c, official, nodes, ways, relations).enforce()
    walks = {(r.complex_id, r.station): (r.distance_m, r.lines) for r in out.tables["walks"].collect()}
    assert set(walks) == {("near", "당산역")}
    metres, lines = walks[("near", "당산역")]
    walk = out.tables["walks"].first()
    assert walk.route_nodes in (list(range(7)), [1, 2, 3, 4, 5, 6]) and abs(walk.start_connector_m - 20) < 0.2 and abs(walk.end_connector_m - 10) < 0.2
    assert lines == ["2"] and abs(metres - 631) <= 2
    status = {r.complex_id: r.status for r in out.tables["links"].collect()}
    assert status == {"near": "linked", "far": "walk_network_unconnected", "none": "coordinate_unconfirmed"}
    assert out.tables["complexes"].filter("complex_id = 'near'").first().station_display == "2당산"
