import os
import re

import corpus_pipeline
import numpy as np
from test_decontaminate import brute as leaks
from test_exact_dedup import lowered
from test_simhash import brute_fingerprint

from hanok.llm import mixing
from hanok.session import shared_dir

WORDS = {"en": "the of and that with this from have which their would about there other these".split(), "fr": "le la les des une dans pour avec cette mais nous vous être où déjà même".split()}


def prose(lang, seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{w}{''.join(rng.choice(WORDS[lang], 1))}" for w in rng.choice(WORDS[lang], n))


def fixture(spark, folder):
    items = [(i, prose("en", 900 + i, 25)) for i in range(4)]
    docs = [(i, prose("en" if i % 3 else "fr", i, 60), "en" if i % 3 else "fr", f"src{i % 4}", 0) for i in range(80)]
    docs += [(100 + i, docs[i][1].upper() if i % 2 else docs[i][1], docs[i][2], docs[i][3], 0) for i in range(10)]  # exact copies
    docs += [(200 + i, docs[i][1] * 40 + " one more", docs[i][2], "src1", 0) for i in range(6)]
    docs += [(300 + i, docs[i][1] * 40 + " other end", docs[i][2], "src1", 0) for i in range(6)]  # near copies of those
    docs += [(400 + i, f"{prose('en', 500 + i, 20)} {items[i][1]} {prose('en', 600 + i, 20)}", "en", "src2", 0) for i in range(4)]
    docs += [(500, "1234 5678 ###", "en", "src0", 0), (501, "", "en", None, 0), (502, None, None, "src0", 0), (7, docs[7][1], docs[7][2], docs[7][3], 0)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def brute(docs, items):
    """What stays before the mix, by rules stated one text at a time."""
    docs = [d for d in docs if re.search(r"[^\W\d_]", d[1] or "")]
    last = {}
    for d in docs:
        last[lowered(d[1])] = max(last.get(lowered(d[1]), d), d, key=lambda x: x[0])
    docs = sorted(last.values())
    prints = {d[0]: brute_fingerprint(d[1]) for d in docs}
    label = {i: i for i in prints}
    for _ in range(3):
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    docs = [d for d in docs if label[d[0]] == d[0]]
    bad = {d for d, *_ in leaks([(d[0], d[1]) for d in docs if len(d[1]) < 5000], items)}
    return [d for d in docs if d[0] not in bad]


def test_pipeline_equals_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    docs, items = fixture(spark, folder)
    kept = brute(docs, items)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    shared = shared_dir(spark)
    there = set(os.listdir(shared))
    got = corpus_pipeline.run(spark, folder)
    left = [d for d in set(os.listdir(shared)) - there if os.path.isdir(os.path.join(shared, d, "")) and "-" in d and os.listdir(os.path.join(shared, d)) and any(f.endswith(".parquet") for f in os.listdir(os.path.join(shared, d)))]
    assert len(left) == 1 and left[0].startswith("stage-source_mix")
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "taken", "copies"]
    # the mix is held against its own test; here it must take its documents from exactly what the stages keep
    whole = spark.createDataFrame(kept, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = {(r.doc_id, r.copies, r.taken) for r in mixing.mix(whole).collect() if r.copies}
    assert {(r.doc_id, r.copies, r.taken) for r in got.collect()} == want
    assert not {d for d, *_ in want} & {*range(400, 404), 500, 501, 502}


def test_stages_take_empty_and_odd_documents(spark, odd_docs, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd_docs, odd_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == columns or name == "source_mix"
        docs.count()
