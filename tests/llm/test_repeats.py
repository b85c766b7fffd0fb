import hashlib
from collections import Counter

import numpy as np
import pytest

from hanok.llm import repeats

W = repeats.WINDOW


def brute(texts):
    seen = Counter(b[i : i + W] for b in texts for i in range(len(b) - W + 1))
    out = []
    for b in texts:
        covered = np.zeros(len(b), bool)
        for i in range(len(b) - W + 1):
            if seen[b[i : i + W]] > 1:
                covered[i : i + W] = True
        edges = np.diff(np.concatenate([[0], covered.astype(int), [0]]))
        spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()))
        out.append((len(b), spans, bytes(np.frombuffer(b, np.uint8)[~covered])))
    return out


def corpus(seed, n=60):
    """Texts with copies, shared passages at their beginning, middle and end, and passages within one text."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdéß "), rng.integers(1, 8)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(4)]
    out = []
    for k in range(n):
        parts = [" ".join(word() for _ in range(rng.integers(0, 120))) for _ in range(3)]
        if k % 3 == 0:
            parts.insert(int(rng.integers(0, 4)), passages[k % 4][: int(rng.integers(150, 260))])
        if k % 7 == 0:
            parts = [passages[0], passages[0]]
        out.append(" ".join(parts))
    near = out[1][:300] + "#" + out[1][301:]
    return [*out, out[1], near, near[:250], "ab" * 300, "a" * (W + 3), "a" * W, "a" * (W - 1), "", None, passages[2] * 2, passages[1][:199]]


@pytest.mark.parametrize("crowd", [repeats.CROWD, 1])
def test_equals_brute_force(make_docs, crowd):
    texts = corpus(crowd)
    got = {r.doc_id: r for r in repeats.remove_repeats(make_docs(texts), crowd).collect()}
    for i, (size, spans, kept) in enumerate(brute([(t or "").encode() for t in texts])):
        assert got[i].n_bytes == size and list(zip(got[i].removed_from, got[i].removed_to)) == spans
        assert hashlib.sha256(bytes(got[i].kept)).digest() == hashlib.sha256(kept).digest()


def test_long_texts_in_pieces(make_docs, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 700)
    texts = corpus(5, 20)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "th": [0] * len(texts), "text": texts})
    windows = Counter()
    for part in repeats._occurrences(iter([batch])):
        for r in part.to_pylist():
            windows.update((r["doc_id"], r["lo"] + k) for k in range(r["run"]))
            assert 0 <= r["left"] <= repeats.REACH and r["run"] - 1 <= r["left"]
    assert windows == Counter((i, k) for i, t in enumerate(texts) for k in range(len((t or "").encode()) - W + 1))


def test_construction_finds_all_shared_windows():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 100, repeats.COLUMNS).astype(np.uint8)
    m = 50
    rows = np.repeat(base[None], m, axis=0)
    rows[np.arange(m), rng.integers(0, repeats.COLUMNS, m)] = 122
    left, run = rng.integers(60, repeats.REACH + 1, m), rng.integers(1, 61, m)
    starts = repeats.REACH - left
    found = repeats.shared_windows(lambda j: rows[:, j], starts, run)
    windows = Counter((c, rows[i, c : c + W].tobytes()) for i in range(m) for c in range(starts[i], starts[i] + run[i]))
    for i in range(m):
        for k in range(run[i]):
            c = starts[i] + k
            assert found[i, k] == (windows[c, rows[i, c : c + W].tobytes()] > 1)


def test_odd_rows(spark, odd_docs, no_docs):
    got = repeats.remove_repeats(odd_docs)
    assert got.count() == odd_docs.count()
    long = [r for r in got.collect() if r.n_bytes == 300_000][0]
    assert (long.removed_from, long.removed_to, bytes(long.kept)) == ([0], [300_000], b"")
    assert repeats.remove_repeats(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "q" * 150 + "r" * 150)] * 2 + [(None, "s" * 150 + "t" * 150)] * 2 + [(1, "u" * 60 + "v" * 200)], "doc_id bigint, text string")
    assert sorted(len(r.kept) for r in repeats.remove_repeats(twice).collect()) == [0, 0, 0, 0, 260]
