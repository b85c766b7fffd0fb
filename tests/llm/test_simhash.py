import re

import numpy as np
import xxhash

from hanok.llm import simhash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    label = list(range(len(prints)))
    for _ in label:
        for a, (_, x) in enumerate(prints):
            for b, (_, y) in enumerate(prints):
                if (x ^ y).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for (i, _), g in zip(prints, label):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(str((i, f"{x:016x}", least.get(g))) for (i, x), g in zip(prints, label))


def test_equals_brute_force(make_docs, odd_docs):
    base = " ".join(f"w{i % 97}x{i}" for i in range(400))
    texts = [base, base + " more", base.replace("w5x5 ", "w5y5 "), base.upper(), "one two", "One two", "", None, base + " tail of words"]
    for docs in (make_docs(texts), odd_docs):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(str(tuple(r)) for r in simhash.near_groups(docs).collect()) == brute_groups(rows)


def test_every_close_pair_meets_at_a_home(rng=np.random.default_rng(1)):
    one = rng.integers(0, 2**63, 300, dtype=np.uint64)
    two = one ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    both = np.concatenate([one, two, [np.uint64(0), np.uint64(2**64 - 1)]])
    for blocks in range(8, 25):
        row, anchor, home = simhash.cover(both, blocks)
        met = set(zip(row.tolist(), anchor.tolist()))
        homes = dict(zip(row[home].tolist(), anchor[home].tolist()))
        assert all((i, homes[i + 300]) in met and (i + 300, homes[i]) in met for i in range(300))
        assert len(met) == len(row)


def test_crowded_cells_are_cut_into_tiles_without_losing_links(spark, monkeypatch):
    # a dense cluster: all fingerprints within two bits of a centre
    values = [0] + [1 << a for a in range(40)] + [1 << a | 1 << b for a in range(20) for b in range(a)]
    fps = spark.createDataFrame([(v,) for v in values + [(1 << 50) - 1]], "fp bigint")

    def groups():
        label = {v: v for v in [r.fp for r in fps.collect()]}
        edges = [(r.a, r.b) for r in simhash.links(fps).collect()]
        for _ in label:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    whole = groups()
    monkeypatch.setattr(simhash, "TILE_HOMES", 5)
    monkeypatch.setattr(simhash, "TILE_VISITORS", 30)
    assert groups() == whole and len(set(whole.values())) == 2


def test_stage(make_docs, odd_docs, no_docs):
    docs = make_docs(["a b c d", "A b c d", "x y z", "", None])
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == [0, 2, 3]
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id = 3").count() == 3  # rows that share an id are one document
    assert simhash.near_groups(no_docs).count() == simhash.deduplicate(no_docs).count() == 0
