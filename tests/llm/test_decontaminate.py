import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hanok.llm import decontaminate


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items):
    """Best window of each (document, item) over all alignments."""
    out = {}
    for d, t in docs:
        x = words(t)
        for i, s in items:
            y = words(s)
            size = min(decontaminate.WINDOW, len(y))
            if len(y) < decontaminate.SHORTEST:
                continue
            for a in range(len(x) - size + 1):
                for b in range(len(y) - size + 1):
                    n = sum(p == q for p, q in zip(x[a : a + size], y[b : b + size]))
                    if n >= 0.8 * size:
                        best = out.get((d, i))
                        out[d, i] = max(best or (n, -b, -a), (n, -b, -a))
    return sorted((d, i, -a, -b, n) for (d, i), (n, b, a) in out.items())


@pytest.fixture
def benchmark(spark):
    rng = np.random.default_rng(0)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 6))) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((30, 20, 15, 9, 6, 4, 13))]
    return items, spark.createDataFrame(items + [(90, items[0][1]), (91, None), (92, "")], "item_id bigint, text string")


def test_equals_brute_force_under_substitutions(spark, benchmark):
    items, table = benchmark
    rng = np.random.default_rng(1)
    docs = []
    for k in range(60):
        item = items[k % len(items)][1].split()
        for _ in range(k % 4):
            item[rng.integers(0, len(item))] = f"sub{k}"
        cut = item[: len(item) - k % 3]
        docs.append((k, f"lead{k} words{k}, " + ("! ".join(cut) if k % 5 == 0 else " ".join(cut).upper()) + f" tail{k}" * (k % 3)))
    rows = spark.createDataFrame(docs + [(70, None), (71, "")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_equal) for r in decontaminate.overlaps(rows, table).collect())
    want = brute(docs, items)
    assert {g[:2] for g in got} <= {w[:2] for w in want}
    sure = [w for w in want if len(words(items[w[1]][1])) >= 13]  # shorter items may lose all seeds to a substitution
    assert [g for g in got if g in sure] == sure
    shuffled = decontaminate.overlaps(rows, table, most_seeds=0).collect()
    assert sorted((r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_equal) for r in shuffled) == got


def test_masks_find_every_window_with_two_substitutions():
    from itertools import combinations

    for bad in combinations(range(13), 2):
        assert any(all(s + o not in bad for o, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for s in range(13 - len(m) + 1))


def test_stage_and_odd_rows(spark, odd_docs, no_docs, benchmark):
    items, table = benchmark
    leak = spark.createDataFrame([(50, "so: " + items[0][1], "en", "s", 0, None, 1), (None, items[1][1], "en", "s", 0, None, 1)], odd_docs.schema)
    kept = decontaminate.clean(odd_docs.unionByName(leak), table)
    assert kept.columns == odd_docs.columns
    # null ids are one document, and one of its rows leaks
    assert kept.count() == odd_docs.filter("doc_id is not null").count()
    assert decontaminate.clean(odd_docs, table).count() == odd_docs.count()
    assert decontaminate.overlaps(no_docs, table).count() == 0
    assert decontaminate.overlaps(odd_docs, table.limit(0)).count() == 0


def test_null_and_repeated_item_ids(spark):
    texts = [" ".join(f"{c}{k}" for k in range(20)) for c in "abcd"]
    items = spark.createDataFrame([(None, texts[0]), (1, texts[1]), (1, texts[2]), (None, texts[3])], "item_id bigint, text string")
    docs = spark.createDataFrame([(k, "so " + t) for k, t in enumerate(texts)] + [(9, "nothing of the kind is here")], "doc_id bigint, text string")
    for most in (decontaminate.MOST_SEEDS, 0):
        got = decontaminate.overlaps(docs, items, most_seeds=most).collect()
        assert {(r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_equal) for r in got} == {(k, i, 1, 0, 13) for k, i in enumerate((None, 1, 1, None))}
        assert len(got) == 4
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [9]


def test_short_items_are_found_wherever_their_words_are_substituted(spark):
    from itertools import combinations

    items, docs = [], []
    for n in range(5, 13):
        item = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for bad in combinations(range(n), n - -(-4 * n // 5)):
            docs.append((len(docs), "before " + " ".join("other" if k in bad else w for k, w in enumerate(item)) + " after"))
        docs.append((len(docs), " ".join(item[: n // 2] + ["other"] * 3 + item[n // 2 + 3 :])))  # too many
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    got = decontaminate.overlaps(rows, table).collect()
    assert sorted((r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_equal) for r in got) == want
    assert len(want) == sum(n if n < 10 else n * (n - 1) // 2 for n in range(5, 13)) == len(docs) - 8
    leaked = {r.doc_id for r in got}
    assert {r.doc_id for r in decontaminate.clean(rows, table).collect()} == {d for d, _ in docs} - leaked


def test_short_masks_equal_brute_force(spark, benchmark):
    items, _ = benchmark
    rng = np.random.default_rng(3)
    short = [(k, " ".join(t.split()[:n])) for (k, t), n in zip(items * 2, (5, 7, 8, 9, 6, 4, 12, 10, 11, 20, 14))]
    short = [(100 + k, t) for k, (_, t) in enumerate(dict.fromkeys((0, t) for _, t in short))]
    docs = []
    for k in range(80):
        item = short[k % len(short)][1].split()
        for _ in range(k % 4):
            item[rng.integers(0, len(item))] = f"sub{k}"
        docs.append((k, f"lead{k} " + " ".join(item) + f" tail{k}" * (k % 3)))
    table = spark.createDataFrame(short, "item_id bigint, text string")
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_equal) for r in decontaminate.overlaps(rows, table).collect())
    assert got == brute(docs, short)


@pytest.fixture
def phrased():
    """Documents and items that share a phrase of seven words, a few of which overlap."""
    phrase = "which of the following is true about"
    own = lambda kind, k: " ".join(f"{kind}{k}x{j}" for j in range(12))
    items = [(k, f"{phrase} {own('item', k)}") for k in range(60)]
    docs = [(k, f"{own('lead', k)} {phrase} {own('doc', k)}") for k in range(200)]
    for k in range(0, 200, 10):
        words_of = items[k % 60][1].split()
        words_of[k % 9] = "other"
        words_of[9 + k % 3] = "another"
        docs[k] = (k, f"so {' '.join(words_of[: 13 + k % 4])} it is")
    return docs, items


def test_common_phrases_align_no_more_than_may_overlap(spark, phrased):
    docs, items = phrased
    rows = spark.createDataFrame(docs, "_row bigint, text string").select("_row", decontaminate._hashed(F.col("text")).alias("hashes"))
    hashed = spark.createDataFrame(items, "item_key bigint, text string").select("item_key", decontaminate._hashed(F.col("text")).alias("hashes"))
    count = lambda **more: decontaminate.alignments(rows, hashed, decontaminate.MASKS, 13, 0.8, **more).count()
    assert count(crowd=10**9) > 180 * 60
    assert count() <= 60
    documents = spark.createDataFrame(docs, "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert len({w[:2] for w in want}) >= 15
    for more in ({}, {"most_seeds": 0}, {"crowd": 0}):
        got = sorted((r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_equal) for r in decontaminate.overlaps(documents, table, **more).collect())
        assert got == want


def test_many_rows_without_an_id_keep_their_alignments_apart(spark, phrased):
    docs, items = phrased
    documents = spark.createDataFrame([(None, t) for _, t in docs], "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.overlaps(documents, table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(None, w[1]) for w in brute(docs, items)}
    assert decontaminate.clean(documents, table).count() == 0


def test_crowded_short_items_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    some = lambda n: " ".join(rng.choice(list("abcd"), n))
    items = list(enumerate(dict.fromkeys(some(n) for n in (5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16) * 4)))
    docs = [(k, some(25)) for k in range(30)]
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), crowd=0)
    assert sorted((r.doc_id, r.item_id, r.doc_start, r.item_start, r.n_equal) for r in got.collect()) == brute(docs, items)
