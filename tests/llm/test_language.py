import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from hanok.llm import language
from hanok.llm.columnar import blocks, text_bytes

WORDS = {
    "en": "the of and that with this from have which their would about there other these".split(),
    "fr": "le la les des une dans pour avec cette mais nous vous être où déjà même".split(),
    "de": "der die das und nicht eine über für sich auch werden können müßte wäre schön".split(),
    "es": "el los las una para como pero más esta señor también año niño está qué".split(),
}


def text(lang, seed, n=40):
    pick = np.random.default_rng(seed).choice(WORDS[lang], n)
    return " ".join(pick)


@pytest.fixture
def corpus(spark):
    rows, k = [], 0
    for lang in WORDS:
        for _ in range(30):
            # one in ten is declared wrongly
            rows.append((k, text(lang, k), "en" if k % 10 == 0 else lang, f"{lang}.example.{'com' if k % 2 else 'org'}"))
            k += 1
    rows += [(1000, "12345 ### 678", "en", "en.example.com"), (1001, "", None, None), (1002, None, "xx", "fr.example.org"), (1003, text("fr", 9999, 3), None, "www.fr.example.com")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, declared string, host string")


def test_text_outweighs_a_wrong_declaration_and_unreadable_texts_go(corpus):
    got = {r.doc_id: r for r in language.identify(corpus).collect()}
    truth = {30 * i + j: lang for i, lang in enumerate(WORDS) for j in range(30)}
    assert all(got[d].language == lang and got[d].accepted for d, lang in truth.items())
    for d in (1000, 1001, 1002):
        assert (got[d].language, got[d].confidence, got[d].accepted, got[d].letters) == ("und", 1.0, False, 0)
    assert got[1003].language == "fr"


def test_priors_and_declarations_decide_between_languages_that_the_text_fits_alike(spark, corpus):
    rows = [(2001, "les las", None, "es.example.com"), (2002, "les las", None, "fr.example.com"), (2003, "les las", "fr", None), (2004, "les las", "es", None)]
    got = {r.doc_id: r.language for r in language.identify(corpus.filter("doc_id < 1000").unionByName(spark.createDataFrame(rows, corpus.schema))).collect()}
    assert [got[k] for k in (2001, 2002, 2003, 2004)] == ["es", "fr", "fr", "es"]


def test_hot_host_and_repeated_rows(spark):
    docs = spark.range(900).selectExpr("id % 450 AS doc_id", "if(id % 2 = 0, 'the of and that with', 'le la les des une') AS text", "if(id % 2 = 0, 'en', 'fr') AS lang", "if(id % 3 = 0, 'hot', concat('h', id % 450)) AS source")
    got = language.of_documents(docs).collect()
    assert len(got) == 900 and {(r.doc_id % 2, r.language) for r in got} == {(0, "en"), (1, "fr")}


def test_trigrams_do_not_cross_texts_and_blocks_agree():
    import pyarrow as pa

    data, offsets = text_bytes(pa.array(["abc", "", "de", None, "Éa 9"]))
    whole, letter = language.trigrams(data, offsets)
    for a, b in blocks(offsets, 3):
        part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        alone, own = language.trigrams(part, cuts)
        assert (alone == whole[offsets[a] : offsets[b]]).all() and (own == letter[offsets[a] : offsets[b]]).all()


def test_odd_rows_and_stage(odd_docs, no_docs):
    got = language.of_documents(odd_docs)
    assert got.count() == odd_docs.count()
    kept = language.keep_accepted(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("text is null and doc_id is not null").count() == 0
    assert language.of_documents(no_docs).count() == language.keep_accepted(no_docs).count() == 0


def test_pages_use_markup_and_address(spark):
    rows = [(i, f"http://www.x{i}.example.com/a", f'<html lang="{lang}-XX"><script>var the = 1;</script><p>{text(lang, i)}</p></html>') for i, lang in enumerate(WORDS)]
    pages = spark.createDataFrame(rows + [(9, None, None)], "page_id bigint, url string, html string")
    got = {r.page_id: r.language for r in language.of_pages(pages).collect()}
    assert got == {**dict(enumerate(WORDS)), 9: "und"}


def brute_languages(rows):
    """Language and confidence of every row, one row and one number at a time."""
    def letters(t):
        folded = [b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in (t or "").encode()]
        padded = [32, *folded, 32]
        return [((padded[i - 1] << 16 | padded[i] << 8 | padded[i + 1]) * 2654435761 % 2**32) >> 17 for i in range(1, len(padded) - 1) if padded[i] != 32]

    def softmax(v):
        powers = [math.exp(x - max(v)) for x in v]
        return [x / sum(powers) for x in powers]

    grams = {r[0]: letters(r[1]) for r in rows}
    said = Counter(r[2] for r in rows if r[2] and grams[r[0]])
    names = sorted(x for x, n in said.items() if n >= sum(said.values()) / 200)
    n, counts = len(names), {x: Counter() for x in names}
    for r in rows:
        if r[2] in names:
            counts[r[2]].update(grams[r[0]])
    size = language.BUCKETS
    chance = [{b: math.log((c + 0.5) / (0.5 * size + counts[x].total())) for b, c in counts[x].items()} for x in names]
    none = [math.log(0.5 / (0.5 * size + counts[x].total())) for x in names]
    text = {i: [sum(chance[k].get(b, none[k]) for b in g) / 3 for k in range(n)] + [len(g) * math.log(1 / size) / 3] for i, g in grams.items()}
    own = {i: softmax(v)[:n] if grams[i] else [0.0] * n for i, v in text.items()}

    def up(host):
        labels = (host or "").lower().split(".")
        return ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""

    sums, declared = defaultdict(lambda: [0.0] * n), defaultdict(lambda: [0.0] * n)
    for i, _, d, host in rows:
        for key in (("h", (host or "").lower()), ("d", up(host)[0]), ("x", up(host)[1])):
            sums[key] = [a + b for a, b in zip(sums[key], own[i], strict=True)]
        declared[d if d in names else None] = [a + b for a, b in zip(declared[d if d in names else None], own[i], strict=True)]
    overall = [1 + sum(v[k] for v in declared.values()) for k in range(n)]
    out = {}
    for i, _, d, host in rows:
        prior = [x / sum(overall) for x in overall]
        for key in (("x", up(host)[1]), ("d", up(host)[0]), ("h", (host or "").lower())):
            rest = [max(a - b, 0.0) for a, b in zip(sums[key], own[i], strict=True)]
            prior = [(a + 5 * p) / (sum(rest) + 5) for a, p in zip(rest, prior, strict=True)]
        score = list(text[i])
        for k in range(n):
            score[k] += math.log(0.98 * max(prior[k], 1e-9))
            if d in names:
                score[k] += math.log((declared[d][k] + 2 / n) / (sum(declared[x][k] for x in names) + 2))
        score[n] += math.log(0.02) - (math.log(n) if d in names else 0)
        fused = softmax(score)
        best = fused.index(max(fused)) if grams[i] else n
        out[i] = ([*names, "und"][best], fused[best] if grams[i] else 1.0)
    return out


def test_posterior_equals_brute_force(spark, corpus):
    short = [(3000 + i, w, (None, "fr", "en")[i % 3], f"h{i % 4}.example.{('com', 'org')[i % 2]}") for i, w in enumerate(["les las", "de", "que", "the", "en un", "42", "la", "É", "un a"] * 3)]
    rows = [tuple(r) for r in corpus.collect()] + short
    got = language.identify(spark.createDataFrame(rows, corpus.schema)).collect()
    want = brute_languages(rows)
    assert {r.doc_id: r.language for r in got} == {i: v[0] for i, v in want.items()}
    assert {r.doc_id: r.confidence for r in got} == pytest.approx({i: v[1] for i, v in want.items()}, abs=1e-9)


def test_languages_come_from_the_declarations(spark):
    nordic = {"fi": "ja on ei se että hän oli mutta ovat kuin".split(), "hu": "az egy hogy nem és van volt meg csak már".split()}
    rows = []
    for i in range(300):
        code = ("fi", "hu", "en")[i % 3]
        words = np.random.default_rng(i).choice(nordic.get(code, WORDS["en"]), 30)
        rows.append((i, " ".join(words), "hu-HU" if code == "hu" else code, "h"))
    rows += [(900, " ".join(nordic["fi"] * 3), None, "h"), (901, "the of and", "qq", "h"), (902, "the of and", "und", "h"), (903, "the of and", "English", "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, declared string, host string")
    narrow = docs.withColumn("declared", language.F.split("declared", "-")[0])
    assert language.declared_languages(narrow) == ["en", "fi", "hu"]  # qq is too rare
    got = {r.doc_id: (r.language, r.accepted) for r in language.identify(docs).collect()}
    assert all(got[i] == (("fi", "hu", "en")[i % 3], True) for i in range(300)) and got[900] == ("fi", True)
    assert {got[i][0] for i in (901, 902, 903)} == {"en"}
    silent = language.identify(docs.withColumn("declared", language.F.lit(None).cast("string"))).collect()
    assert len(silent) == len(rows) and {(r.language, r.accepted, r.letters > 0) for r in silent} == {("und", False, True)}
