import hashlib
from collections import defaultdict

from hanok.llm import exact_dedup


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[hashlib.sha256(lowered(text).encode()).hexdigest()].append(doc_id)
    out = []
    for sha, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept = 0
        for i in ids:
            stays = i == keep and not kept
            kept += stays
            out.append((i, keep, len(ids), stays, sha))
    return out


def key(rows):
    return sorted((str(x) for x in rows))


def test_equals_brute_force_with_and_without_heavy_digests(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for heavy in (1, 256):
        assert key(map(tuple, exact_dedup.group_copies(odd_docs, heavy=heavy).collect())) == key(brute(rows))


def test_only_ascii_letters_fold(make_docs):
    docs = make_docs(["É ABC", "é abc", "É abc", "K", "K"])
    sizes = {r.doc_id: (r.group_size, r.kept) for r in exact_dedup.group_copies(docs).collect()}
    assert sizes == {0: (2, False), 1: (1, True), 2: (2, True), 3: (1, True), 4: (1, True)}


def test_a_third_of_all_rows_is_one_text(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'Hot text', concat('t', id div 2)) AS text")
    heavy = exact_dedup.winners(exact_dedup.group_copies(docs).selectExpr("doc_id", "text_sha256 AS _hh_sha")).collect()
    assert ("Hot text", 2997, 1000) in [("Hot text", r._hh_keep, r._hh_size) for r in heavy]
    kept = exact_dedup.deduplicate(docs)
    assert kept.filter("text = 'Hot text'").collect()[0].doc_id == 2997
    assert kept.count() == kept.select("text").distinct().count() == docs.select("text").distinct().count()


def test_the_stage_keeps_columns_and_one_of_repeated_rows(odd_docs, no_docs):
    kept = exact_dedup.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [lowered(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({lowered(r.text) for r in odd_docs.collect()})
    assert exact_dedup.group_copies(no_docs).count() == exact_dedup.deduplicate(no_docs).count() == 0
