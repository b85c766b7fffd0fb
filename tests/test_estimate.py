import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from hanok.functions.months import month_index, month_name
from hanok.operators import estimate as es
from hanok.plans import comparison as cmp

SALE = "complex_id string, date date, ym string, midx int, area double, floor int, price bigint"
START, END = "2025-03", "2026-03"


def sale(cid, ym, price, area=59.9, floor=12, day=10):
    y, m = map(int, ym.split("-"))
    return (cid, dt.date(y, m, day), ym, month_index(ym), area, floor, price)


def table(spark, rows):
    return spark.createDataFrame(rows, SALE)


def quantile(xs, p):
    xs = sorted(xs)
    i = (len(xs) - 1) * p
    lo = int(i)
    return xs[lo] if lo == i else xs[lo] + (xs[lo + 1] - xs[lo]) * (i - lo)


def middle(weighted):
    xs = sorted(weighted)
    total = sum(w for _, w in xs)
    run = 0
    for i, (p, w) in enumerate(xs):
        run += w
        if 2 * run > total:
            return p
        if 2 * run == total:
            return (p + xs[i + 1][0]) / 2


def weight(d):
    return {0: 20, 1: 16, 2: 13, 3: 10}.get(d, 6 if d <= 6 else 3)


def plain_series(rows, target, no_future):
    """Restatement of the rule for one area: rows are (month index, price)."""
    near = [(abs(m - target), p) for m, p in rows if abs(m - target) <= 12 and not (no_future and m > target)]
    context = [p for d, p in near if d <= 3]
    if len(context) >= 3:
        center = statistics.median(context)
        mad = statistics.median(abs(p - center) for p in context)
        limit = max(center * 0.20, mad * 1.4826 * 3, 10000)
    for w in (0, 1, 2, 3, 6, 12):
        raw = [(d, p) for d, p in near if d <= w]
        kept = raw if len(context) < 3 else [(d, p) for d, p in raw if abs(p - center) <= limit]
        if not kept or (w == 0 and len(kept) == 1 and len(context) < 3) or (0 < w < 12 and len(kept) == 1):
            continue
        prices = [p for _, p in kept]
        return (float(middle([(p, weight(d)) for d, p in kept])), quantile(prices, 0.25), quantile(prices, 0.75), len(kept), w, len(raw) - len(kept))
    return None


def plain_estimate(rows, target, no_future, kind):
    rows = [r for r in rows if r[5] >= 10]
    low, high = es.fv.ANALYSIS_BANDS[kind]
    groups = {}
    for r in rows:
        if low <= r[4] <= high:
            groups.setdefault(round(r[4], 2), []).append((r[3], r[6]))
    order = sorted(groups, key=lambda a: (-len(groups[a]), abs(a - kind), a))
    if not order:
        return None
    primary = order[0]
    rest = sorted(order[1:], key=lambda a: (round(abs(a - primary), 6), -len(groups[a])))
    for a in [primary, *rest]:
        e = plain_series(groups[a], target, no_future)
        if e:
            return (*e, a, a != primary)
    return None


def test_random_series_equal_the_plain_restatement(spark):
    rng = random.Random(7)
    rows = []
    for c in range(150):
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 30])):
            spread = rng.choice([(-16, 28), (-1, 1), (0, 0), (11, 12)])
            ym = month_name(month_index(START) + rng.randint(*spread))
            price = rng.choice([50000, 52000, 52000, 60000, 61000, 90000, 200000])
            rows.append(sale(f"C{c:02}", ym, price, rng.choice([59.0, 59.5, 59.95, 60.25, 84.5]), rng.choice([3, 9, 10, 20])))
    targets = cmp.sides(START, END)
    got = {
        (r.complex_id, r.area_type, r.side): (r.value, r.low, r.high, r.samples, r.window, r.outliers, float(r.area_used), r.area_fallback)
        for r in es.estimates(table(spark, rows), targets).collect()
    }
    want = {}
    for c in {r[0] for r in rows}:
        for kind in (59, 84):
            for side, (target, no_future) in targets.items():
                e = plain_estimate([r for r in rows if r[0] == c], target, no_future, kind)
                if e:
                    want[(c, kind, side)] = e
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k
    assert {w[4] for w in want.values()} >= {0, 1, 2, 3, 6, 12} and any(w[7] for w in want.values()) and any(w[5] for w in want.values())


def first(spark, rows, side="start"):
    got = es.estimates(table(spark, rows), cmp.sides(START, END)).filter(F.col("side") == side).collect()
    return got[0] if got else None


def test_single_exact_trade_needs_context(spark):
    assert first(spark, [sale("A", "2025-03", 50000)]).window == 12
    got = first(spark, [sale("A", "2025-03", 50000), sale("A", "2025-05", 51000), sale("A", "2025-01", 52000)])
    assert (got.window, got.samples, got.value) == (0, 1, 50000.0)


def test_outlier_is_left_out(spark):
    rows = [sale("A", "2025-03", p) for p in (50000, 51000, 52000, 99000)]
    got = first(spark, rows)
    assert (got.value, got.samples, got.outliers) == (51000.0, 3, 1)


def test_exact_half_of_the_weight_averages(spark):
    got = first(spark, [sale("A", "2025-03", 50000), sale("A", "2025-03", 60000)])
    assert got.value == 55000.0


def test_end_side_does_not_look_ahead(spark):
    rows = [sale("A", "2026-05", 50000), sale("A", "2026-06", 50000)]
    assert first(spark, rows, "end") is None


def test_low_floors_do_not_count(spark):
    assert first(spark, [sale("A", "2025-03", 50000, floor=9)] * 5) is None


def test_a_hot_complex_is_counted_not_collected(spark):
    """Copies of one trade are one record after the map side, and weigh as many."""
    rows = [sale("HOT", "2025-03", 50000)] * 3000 + [sale("HOT", "2025-03", 60000)] * 2999 + [sale(f"C{i}", "2025-03", 40000) for i in range(50)]
    counts = es.price_counts(es.typed_trades(table(spark, rows)), cmp.sides(START, END))
    assert counts.filter("complex_id = 'HOT'").count() == 4  # two prices, within reach of both sides
    assert first(spark, [r for r in rows if r[0] == "HOT"]).value == 50000.0


def test_comparison_ranks_and_explains(spark):
    c = spark.createDataFrame(
        [("A", "가", "r", 500, 200.0, "2000.01"), ("B", "나", "r", 500, None, "2000.01"), ("C", "다", "r", 500, 50.0, "2000.01"), ("D", "라", "r", 299, 200.0, ""), ("E", "마", "r", 300, 200.0, "1990")],
        "complex_id string, name string, region string, households int, far double, completed string",
    )
    rows = [sale(x, ym, p) for x, a, b in (("A", 50000, 60000), ("B", 50000, 70000), ("C", 1, 1)) for ym, p in ((START, a), (START, a), (END, b), (END, b))]
    got = cmp.ranked(cmp.compare(c, table(spark, rows), START, END)).orderBy("line").collect()
    assert [(r.complex_id, r["rank"], r.change, r.rate, r.confidence, r.missing) for r in got] == [
        ("B", 1, 20000.0, 40.0, 3, None), ("A", 2, 10000.0, 20.0, 3, None), ("E", None, None, None, 1, "no_trades_of_type")
    ]
    assert got[0].reasons[:2] == ["과거: 대표 전용 59.90㎡ 사용", "과거: 목표월 10층 이상 거래 사용"]
    assert "과거: 정상거래 표본 2건" in got[0].reasons


def test_numbering_covers_every_row_once(spark):
    from hanok.operators.ranking import number_rows

    df = spark.range(5000).select("id", (F.col("id") % 7).alias("v"))
    got = number_rows(df, F.col("v").desc(), F.col("id"), partitions=9).collect()
    ordered = sorted(got, key=lambda r: (-r.v, r.id))
    assert [r["rank"] for r in ordered] == list(range(1, 5001))
