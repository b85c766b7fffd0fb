import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from hanok.functions.similarity import block_ratio, in_common, ratios


def pairs(seed, n):
    rng = random.Random(seed)
    alphabet = ["ab", "가나다라", "xyz😀"][seed % 3]
    first = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(n)]
    other = [x[: len(x) // 2] + "".join(rng.choices("ab가", k=rng.randint(0, 3))) + x[len(x) // 2 + rng.randint(0, 2) :] if rng.random() < 0.6 else "".join(rng.choices("ab가나", k=rng.randint(0, 20))) for x in first]
    return first, other


@pytest.mark.parametrize("seed", range(6))
def test_equals_one_pair_at_a_time(seed):
    a, b = pairs(seed, 300)
    want = [SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)]
    assert ratios(a, b).tolist() == want
    least = ratios(a, b, 0.7).tolist()
    assert all(x == w if w >= 0.7 else x in (0.0, w) for x, w in zip(least, want))


def test_it_is_not_symmetric_and_counts_copies():
    one, two = "나다바바바", "나바바다바"
    assert ratios([one, two], [two, one]).tolist() == [0.6, 0.8]
    code = lambda x: np.array([[ord(c) for c in x]], np.uint32)
    assert in_common(code("aabbc"), np.array([5]), code("abbbx"), np.array([5])).tolist() == [3]


def test_empty_names_long_names_and_nulls(spark):
    long = "가나다라" * 70
    assert ratios(["", "", "a"], ["", "a", "a"]).tolist() == [1.0, 0.0, 1.0]
    assert ratios([long], [long[3:]]).tolist() == [SequenceMatcher(None, long, long[3:]).ratio()]
    table = spark.createDataFrame([("ab", "ac"), (None, "a"), ("a", None)], "a string, b string")
    assert [r[0] for r in table.select(block_ratio("a", "b")).collect()] == [0.5, None, None]
