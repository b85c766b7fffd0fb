import re
from collections import defaultdict

from hanok.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_are_a_water_level(spark):
    sizes = spark.createDataFrame([(None, 10), ("b", 1000), ("a", 10), ("c", 500), ("d", 0)], "source string, size bigint")
    got = {r.source: (r.source_size, r.target) for r in mixing.targets(sizes).collect()}
    # weights a 5, b 2, c 1, d 5, null 2; a, d and null end at twice their size, the rest shares 2 : 1 until b is full
    assert got["a"] == (10, 20.0) and got["d"] == (0, 0.0) and got[None] == (10, 20.0)
    total = 1.5 * 1520
    level = (total - 40) / 3
    assert abs(got["b"][1] - min(2000, 2 * level)) < 1e-9 and abs(got["c"][1] - level) < 1e-9
    assert abs(sum(t for _, t in got.values()) - total) < 1e-6


def test_mix_comes_near_its_targets_and_repeats_exactly(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "array_join(array_repeat('w', cast(1 + id * id % 40 as int)), ' ') AS text", "if(id % 3 = 0, 'hot', concat('s', id % 7)) AS source")
    one = sorted(map(tuple, mixing.mix(docs).collect()))
    assert one == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    taken, target = defaultdict(int), {}
    for doc_id, source, size, _, t, k, copies in one:
        assert 0 <= k <= 2 * size and k == copies * size
        taken[source] += k
        target[source] = t
    assert all(abs(taken[s] - target[s]) <= max(40, 0.01 * target[s]) for s in target)


def test_salted_and_broadcast_sources_agree(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id AS doc_id", "array_join(array_repeat('w', cast(1 + id % 9 as int)), ' ') AS text", "concat('s', id % 5) AS source")
    few = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == few


def test_threshold_is_the_longest_prefix_that_fits(spark):
    # two hashes share the first level's bucket, two more share all bits
    low = 5 << (mixing.HASH_BITS - mixing.LEVEL_BITS)
    rows = spark.createDataFrame([(1, 3, 10), (1, low, 10), (1, low + 1, 10), (1, low + 1, 10), (1, low + 2, 10)], "rank int, h bigint, size bigint")
    for budget, below in ((9.0, 3), (10.0, low), (25.0, low + 1), (39.9, low + 1), (40.0, low + 2), (50.0, mixing.TOP)):
        got = mixing._threshold(rows, spark.createDataFrame([(1, budget)], "rank int, budget double"), True)
        assert got.first().below == below


def test_odd_rows(odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert sorted(r.size for r in got) == sorted(words(r.text) for r in odd_docs.collect())
    assert all(r.taken == 0 for r in got if r["size"] == 0)
    stage = mixing.mixed(odd_docs)
    assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "taken", "copies"]
    assert {r.size for r in stage.collect()} <= {r.size for r in odd_docs.collect()}  # the input's own column
    assert mixing.mix(no_docs).count() == mixing.mixed(no_docs).count() == 0
