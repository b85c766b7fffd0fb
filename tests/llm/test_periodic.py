import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from hanok.llm import periodic
from hanok.llm.queries.op13 import op13_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, shortest=12):
    """(start, length, period) by comparing the words at every lag, one after the other."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = p
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - p]:
                j += 1
            if j - i + p >= max(shortest, 2 * p):
                found.setdefault((i - p, j - i + p), p)
            i = j + 1
    return sorted((s, p, n) for (s, n), p in found.items())


def row(doc_id, text):
    """A row of the query, from the contract."""
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, p, k in runs for i in range(s + p, s + k)}
    best = min(((-k, s, p) for s, p, k in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{s},{k},{p}\n" for s, p, k in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def odd(kind, rng):
    n = int(rng.integers(0, 300))
    if kind == 0:
        return rng.integers(0, rng.integers(1, 4), n)
    if kind == 1:
        return np.resize(rng.integers(0, 50, rng.integers(1, 60)), n)
    if kind == 2:
        return np.concatenate([rng.integers(0, 90, n // 2), np.resize(np.concatenate([np.zeros(rng.integers(1, 60), int), rng.integers(0, 3, 3)]), n)])
    x = [0]
    for _ in range(8):
        x = x + [1 - v for v in x]
    return np.array(x)


def test_runs_equal_brute_force_for_many_texts_at_once():
    rng = np.random.default_rng(3)
    for _ in range(60):
        texts = [odd(int(rng.integers(4)), rng).astype(np.uint64) for _ in range(rng.integers(1, 6))]
        counts = np.array([len(t) for t in texts])
        got = periodic.find(np.concatenate(texts), counts).tolist()
        before = np.cumsum(counts) - counts
        assert [(s, p, e - s) for s, e, p in got] == [(s + b, p, k) for t, b in zip(texts, before.tolist()) for s, p, k in brute(t.tolist())]


def test_one_word_sixty_thousand_times_is_one_run():
    assert periodic.find(np.zeros(60_000, np.uint64), np.array([60_000])).tolist() == [[0, 60_000, 1]]


def test_colliding_hashes_do_not_change_the_result(monkeypatch):
    rng = np.random.default_rng(4)
    ids = np.concatenate([np.resize(rng.integers(0, 9, 40), 170), rng.integers(0, 9, 60)]).astype(np.uint64)
    want = brute(ids.tolist())
    monkeypatch.setattr(periodic._Prefix, "of", lambda self, start, size: np.zeros(len(start), np.uint64))
    assert [(s, p, e - s) for s, e, p in periodic.find(ids, np.array([len(ids)])).tolist()] == want


def test_a_block_boundary_does_not_matter(monkeypatch):
    texts = ["a b c " * 9, "x", "", "p q " * 20 + "end", None, "r " * 12] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    whole = [r for b in periodic._batch(12)(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(periodic, "BLOCK", 50)
    assert [r for b in periodic._batch(12)(iter([batch])) for r in b.to_pylist()] == whole
    assert [r["collapsed"] for r in whole[:6]] == [b"a b c", b"x", b"", b"p q end", b"", b"r"]


@pytest.mark.parametrize("table", ["odd", "planted", "empty"])
def test_query_equals_brute_force(spark, tmp_path, odd_docs, table):
    if table == "planted":
        rng = np.random.default_rng(6)
        texts = [" ".join(f"w{k}" for k in odd(int(rng.integers(3)), rng)) for _ in range(150)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    else:
        docs = odd_docs if table == "odd" else odd_docs.limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    small = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 100_000]
    want = [row(*r) for r in small]
    if table == "odd":  # brute force would take long for one word 60,000 times
        n = 60_000
        doc_id = next(r.doc_id for r in docs.collect() if len(r.text or "") >= 100_000)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((doc_id, 1, 0, n, 1, 1000 * n, sha(f"0,{n},1\n"), sha("word")))
    assert got == sorted(want, key=str)
