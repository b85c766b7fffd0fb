import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from hanok.llm import maxent
from hanok.llm.columnar import span_hashes, text_bytes, words


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["</s> "]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 7 == 2


def brute_base(rows):
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        ts = tokens(t)
        out.append((d, held(d), len(ts), sum(x in counts for x in ts), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in ts)))
    return out


def same(got, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    return len(got) == len(want) and all(a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) for a, b in zip(got, sorted(want, key=str)))


def sentences(n, seed=0):
    """A small grammar: what follows depends on the word before, so context must help."""
    rng = np.random.default_rng(seed)
    heads, tails = [f"head{i}" for i in range(12)], [f"Tail{i}" for i in range(200)]
    return [" ".join(f"{heads[h]} {tails[(h * 16 + rng.integers(0, 16)) % 200]}" for h in rng.integers(0, 12, rng.integers(5, 60))) for _ in range(n)]


def test_base_scores_equal_brute_force(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert same(maxent.score(odd_docs).collect(), brute_base(rows))
    assert maxent.score(no_docs).count() == 0


def test_rare_tokens_by_the_join_equal_tokens_at_hand(make_docs, monkeypatch):
    docs = make_docs(sentences(150))
    at_hand = sorted(map(tuple, maxent.score(docs).collect()))
    monkeypatch.setattr(maxent, "FREQUENT", 40)
    joined = sorted(map(tuple, maxent.score(docs).collect()))
    # averaged weights differ in the last bits, as partial sums arrive in any order
    assert all(a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 1e-3 * abs(a[6]) for a, b in zip(at_hand, joined, strict=True))


def test_context_beats_the_base_on_held_out_texts(make_docs):
    got = [r for r in maxent.score(make_docs(sentences(1500))).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)  # both negative


def test_without_training_texts(make_docs):
    docs = make_docs(["a b", None], first=next(i for i in range(100) if held(i) and held(i + 1)) if any(held(i) and held(i + 1) for i in range(100)) else 0)
    got = maxent.score(docs.filter(docs.doc_id == -1).unionByName(docs)).collect()
    assert len(got) == 2 and all(np.isfinite(r.score) and r.base_score <= 0 for r in got)


def test_class_probabilities_sum_to_one_and_tokens_reset_at_texts():
    data, offsets = text_bytes(pa.array(["one two three", None, "ONE two"]))
    t = maxent.tokenize(data, offsets)
    assert t.hashes[0] == t.hashes[5] and t.hashes[1] == t.hashes[6] and (t.hashes[[3, 4, 7]] == maxent.END).all()
    rows = maxent.features(t)
    assert (rows[0] == rows[5]).all() and (rows[1] == rows[6]).all() and (rows[0] == rows[4]).all()
    w = np.random.default_rng(0).normal(size=(maxent.ROWS + 1, maxent.CLASSES)).astype(np.float32)
    assert np.allclose(np.exp(maxent.class_scores(w, rows)).sum(axis=1), 1, atol=1e-4)


def test_span_hashes_depend_on_the_bytes_alone():
    data, offsets = text_bytes(pa.array(["ab cab  ab\x00", "ab"]))
    starts, ends, of = words(data, offsets)
    assert [bytes(data[a:b]) for a, b in zip(starts, ends)] == [b"ab", b"cab", b"ab\x00", b"ab"] and of.tolist() == [0, 0, 0, 1]
    h = span_hashes(data, starts, ends)
    assert h[0] == h[3] and len(set(h.tolist())) == 3


def test_group_sums():
    rng = np.random.default_rng(4)
    values = rng.normal(size=(500, 3))
    cuts = np.unique(np.concatenate([[0], rng.integers(0, 500, 60), [499]]))
    assert np.allclose(maxent.group_sums(values, cuts), np.add.reduceat(values, cuts, axis=0))
