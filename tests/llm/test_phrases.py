import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hanok.llm import phrases


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least=10, longest=3, top=2000, contained=50):
    """The contract's result for (lang, text) rows, in plain Python."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f["und" if lang is None else lang, tuple(w[i : i + k])] += 1
    out = []
    for lang in n:
        found = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        keep = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if not any(100 * b >= contained * a for b in longer):
                score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                keep.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(keep)[:top])]
    return sorted(out)


def texts(seed, n, vocabulary=12):
    rng = np.random.default_rng(seed)
    words = [*("word%d" % i for i in range(vocabulary)), "É", "New", "York", "日本"]
    for _ in range(n):
        size = int(rng.integers(0, 60))
        yield " ".join(rng.choice(words, size)).replace("word3", "word3,").replace("word5", "word5\n")


@pytest.fixture
def rows(spark):
    made = [(None if i % 7 == 0 else "und" if i % 7 == 1 else "en" if i % 3 else "fr", t) for i, t in enumerate(texts(1, 300))]
    return made, spark.createDataFrame([(*r, "x", 1) for r in made], "lang string, text string, word string, f int").repartition(5)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_equals_brute_force(rows):
    made, table = rows
    assert got(phrases.collocations(table)) == brute(made)
    assert got(phrases.collocations(table, least=25, longest=4, top=7, contained=30)) == brute(made, 25, 4, 7, 30)


@pytest.mark.parametrize("sample, proposed, passes", [(1, 1, 1), (1, 10**9, 3), (7, 2, None)])
def test_border_failures_lead_to_further_passes(rows, sample, proposed, passes):
    made, table = rows
    counts = phrases.mine(table, sample=sample, proposed=proposed)
    assert passes is None or len(counts.passes) == passes
    assert got(phrases.collocations(table, sample=sample, proposed=proposed)) == brute(made)


def test_a_full_bitmap_only_counts_more(rows, monkeypatch):
    made, table = rows
    monkeypatch.setattr(phrases, "MOST_BITS", 3)
    assert got(phrases.collocations(table, sample=3)) == brute(made)


def test_words_of_one_hash_get_another_seed(rows, monkeypatch):
    made, table = rows
    counter, seeds = phrases._counter, []

    def colliding(seed, *rest):
        seeds.append(seed)
        run = counter(seed, *rest)

        def squeezed(batches):
            for batch in run(batches):
                w0 = batch.column("w0").to_numpy()
                yield batch.set_column(batch.schema.get_field_index("w0"), "w0", pa.array(w0 % 5 + 1)) if seed == 1 else batch

        return squeezed

    monkeypatch.setattr(phrases, "_counter", colliding)
    assert got(phrases.collocations(table)) == brute(made) and set(seeds) == {1, 2}


def test_rows_of_one_key_are_told_apart():
    columns = [np.array([1, 2, 1, 2, 1], np.uint64), np.array([0, 0, 0, 0, 1])]
    at, size = phrases._grouped(np.zeros(5, np.uint64), columns)
    assert sorted((columns[0][i], columns[1][i], n) for i, n in zip(at, size)) == [(1, 0, 2), (1, 1, 1), (2, 0, 2)]


def test_tokens_end_with_their_text():
    data = np.frombuffer(b"ab cdef.g  h\tiq", np.uint8)
    starts, ends, text, piece = phrases.tokens(data, np.array([0, 2, 2, 5, 14, 15]))
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["ab", "cd", "ef", "g", "h", "i", "q"]
    assert text.tolist() == [0, 2, 3, 3, 3, 3, 4] and [len(set(piece[[i, i + 1]])) for i in range(6)] == [2, 2, 2, 1, 1, 2]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 10**12
    one = spark.createDataFrame([(9, 1, big), (9, 2, big - 7)], "g bigint, w0 bigint, f bigint")
    two = spark.createDataFrame([(9, 1, 2, big - 11)], "g bigint, w0 bigint, w1 bigint, f bigint")
    row = phrases._scored(two, 2, {1: one, 2: two}).first()
    assert row.score == 1_000_000 * (big - 11) ** 2 // (big * (big - 7))


def test_a_hot_phrase_and_odd_texts(spark, odd_docs, no_docs):
    made = [(r.lang, r.text) for r in odd_docs.collect()] + [("en", "Hot phrase here")] * 3000
    table = odd_docs.select("lang", "text").unionByName(spark.range(3000).selectExpr("'en' AS lang", "'Hot phrase here' AS text"))
    assert got(phrases.collocations(table)) == brute(made)
    assert got(phrases.collocations(no_docs)) == []
    assert isinstance(phrases._spelled(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)), pa.Array)
