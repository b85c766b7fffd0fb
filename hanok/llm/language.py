"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per row, languages being those that the rows declare and ``und`` (none of them).
A declared code of two or three letters is a language if at least ``LEAST_SHARE`` of the rows that declare one and hold a
letter declare it, so there are at most ``1 / LEAST_SHARE`` languages and the model's size is bounded:

- the text: hashed byte trigrams under one distribution per language, learnt from all rows by their declared language
  (``und`` is the uniform distribution); trigrams overlap, so their log-likelihood counts a third;
- the declared language (an ``html lang`` or a metadata field) under the chance that a text of each language is declared
  so, counted over all rows by the text's own posterior;
- the address: priors of the suffix, the registered domain and the host, each a grouped sum of text posteriors drawn to
  the level above it, and to the overall shares at the top. A row's own share is taken out of the sums it meets.

Trigram counts are summed per task into one fixed table; model and priors cover every row of the input. Scores go to a
narrow staged table, so texts are read twice and never shuffled. Hosts are joined by an equi-join on narrow rows.

Defined cases: where no row declares a language, every row is ``und``, confidence 1, and rejected. A text without letters (null and empty ones included) has language ``und``, confidence 1, and is rejected;
so is a text for which no language reaches ``ACCEPT``. A null, unknown or too rare declared language is no evidence; a null host
shares the prior of the empty host. Long texts are scored whole. Repeated rows get equal results unless they share a
host's sums with themselves. Extra columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.llm.columnar import LOWERED, blocks, text_bytes
from hanok.llm.tables import staged

UNKNOWN = "und"
#: Codes that name no language, and the least share of the declaring rows that makes a code a language.
NO_LANGUAGE, LEAST_SHARE = ("mis", "mul", "und", "zxx"), 1 / 200
#: A character that has letters in its bytes: anything but the ASCII characters that are none.
LETTER = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
BUCKETS, ALPHA, TEMPER = 1 << 15, 0.5, 1 / 3
#: Strength of the level above in a prior, of the uniform part in declarations, prior of ``und``, least posterior.
DRAW, DECLARED_DRAW, UNKNOWN_PRIOR, ACCEPT = 5.0, 2.0, 0.02, 0.5
BLOCK = 1 << 22

#: Letters keep their lower-case byte (any byte of a non-ASCII character counts), everything else becomes a space.
_FOLD = np.where((np.char.isalpha(np.array([chr(i) if i < 128 else " " for i in range(256)]))) | (np.arange(256) >= 128), LOWERED, 32).astype(np.uint8)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the trigram around each byte, whether its middle is a letter). A text's ends count as spaces."""
    folded = np.full(len(data) + 2, 32, np.uint32)
    folded[1:-1] = _FOLD[data]
    middle, left, right = folded[1:-1], folded[:-2].copy(), folded[2:].copy()
    filled = offsets[:-1] < offsets[1:]
    left[offsets[:-1][filled]] = 32
    right[offsets[1:][filled] - 1] = 32
    mixed = (left << np.uint32(16) | middle << np.uint32(8) | right) * np.uint32(2654435761)
    return mixed >> np.uint32(17), middle != 32


def _counts(languages: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            known = np.array([languages.index(x) if x in languages else -1 for x in batch.column("declared").to_pylist()], np.int64)
            for a, b in blocks(offsets, BLOCK):
                part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                bucket, letter = trigrams(part, cuts)
                of = np.repeat(known[a:b], np.diff(cuts))
                use = letter & (of >= 0)
                total += np.bincount(of[use] * BUCKETS + bucket[use], minlength=total.size).reshape(total.shape)
        kind, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[kind, bucket])], names=["kind", "bucket", "n"])

    return run


def declared_languages(rows: DataFrame, least: float = LEAST_SHARE) -> list[str]:
    """The languages of ``rows(text, declared)``, sorted: codes counted over all rows that hold a letter."""
    code = F.col("declared").rlike("^[a-z]{2,3}$") & ~F.col("declared").isin(*NO_LANGUAGE)
    counts = rows.filter(code & F.col("text").rlike(LETTER)).groupBy("declared").count().collect()  # at most 26^2 + 26^3 rows
    total = sum(r["count"] for r in counts)
    return sorted(r["declared"] for r in counts if r["count"] >= least * total)


def text_model(rows: DataFrame, languages: Sequence[str]) -> np.ndarray:
    """Log-probability of each bucket by language, ``und`` last; at most languages x buckets numbers come to the driver."""
    sums = rows.mapInArrow(_counts(languages), "kind int, bucket int, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()
    table = np.full((len(languages) + 1, BUCKETS), ALPHA)
    table[found["kind"], found["bucket"]] += found["n"]
    table[-1] = 1.0
    return np.log(table / table.sum(axis=1, keepdims=True))


def _softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=0))
    return powers / powers.sum(axis=0)


def _scores(model: np.ndarray, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            out = np.zeros((len(model) + 1, batch.num_rows))
            for a, b in blocks(offsets, BLOCK):
                part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                bucket, letter = trigrams(part, cuts)
                at = np.concatenate([[0], np.cumsum(letter)])[cuts]
                bucket = bucket[letter]
                out[-1, a:b] = np.diff(at)
                for k, row in enumerate(model):
                    out[k, a:b] = np.diff(np.concatenate([[0.0], np.cumsum(row[bucket])])[at])
            own = np.where(out[-1] > 0, _softmax(TEMPER * out[:-1]), 0.0)[: len(model) - 1]
            kept = [batch.column(c) for c in ("doc_id", "declared", "host")]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, out), *map(pa.array, own)], names=["doc_id", "declared", "host", *names, "letters", *[f"p{i}" for i in range(len(own))]])

    return run


def _fuse(said: np.ndarray, share: np.ndarray, languages: Sequence[str], accept: float):
    """Posterior of every row from its text scores, its declaration (``said``: log-chance by declared and true language)
    and the sums of its host (h), domain (d) and suffix (x) without its own part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, kinds = len(languages), np.array([*languages, UNKNOWN])
        for batch in batches:

            def columns(letter: str, count: int = n) -> np.ndarray:
                return np.stack([batch.column(f"{letter}{i}").to_numpy() for i in range(count)])

            text, own = TEMPER * columns("s", n + 1), columns("p")
            prior = np.repeat(share[:, None], batch.num_rows, axis=1)
            for level in "xdh":
                rest = np.maximum(columns(level) - own, 0.0)
                prior = (rest + DRAW * prior) / (rest.sum(axis=0) + DRAW)
            told = np.array([languages.index(d) if d else -1 for d in batch.column("declared").to_pylist()], np.int64)
            stated = np.where(told >= 0, said[told].T, 0.0)
            chance = text.copy()
            chance[:n] += stated + np.log((1 - UNKNOWN_PRIOR) * np.maximum(prior, 1e-9))
            chance[n] += np.where(told >= 0, -np.log(n), 0.0) + np.log(UNKNOWN_PRIOR)
            fused, letters = _softmax(chance), batch.column("letters").to_numpy()
            read = letters > 0
            best = np.where(read, fused.argmax(axis=0), n)
            alone = np.where(read, text.argmax(axis=0), n)
            sure = np.where(read, fused.max(axis=0), 1.0)
            out = [kinds[best], sure, read & (best < n) & (sure >= accept), kinds[alone], letters.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out)], names=["doc_id", "language", "confidence", "accepted", "text_language", "letters"])

    return run


def identify(rows: DataFrame, languages: Sequence[str] | None = None, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, language, confidence, accepted, text_language, letters), one row per row of ``rows(doc_id, text, declared, host)``.

    ``languages`` are those that the rows declare (:func:`declared_languages`) unless they are given.
    """
    host = F.lower(F.coalesce(F.col("host").cast("string"), F.lit("")))
    declared = F.split(F.lower(F.trim(F.col("declared").cast("string"))), "[-_]")[0]
    narrow = rows.select("doc_id", F.col("text").cast("string").alias("text"), declared.alias("declared"), host.alias("host"))
    languages = declared_languages(narrow) if languages is None else list(languages)
    if not languages:
        letters = F.octet_length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "")).cast("bigint")
        und = F.lit(UNKNOWN)
        return narrow.select("doc_id", und.alias("language"), F.lit(1.0).alias("confidence"), F.lit(False).alias("accepted"), und.alias("text_language"), letters.alias("letters"))
    narrow = narrow.withColumn("declared", F.when(F.col("declared").isin(*languages), F.col("declared")))
    names = [f"s{i}" for i in range(len(languages) + 1)]
    id_type, n = dict(narrow.dtypes)["doc_id"], len(languages)
    own = [f"p{i}" for i in range(n)]
    schema = f"doc_id {id_type}, declared string, host string, {', '.join(f'{c} double' for c in [*names, 'letters', *own])}"
    model = text_model(narrow.select("text", "declared"), languages)
    scored = staged(narrow.mapInArrow(_scores(model, names), schema), "language-scores")

    # declarations: chance of each declared language given the text's language, and the overall shares
    sums = scored.groupBy("declared").agg(*[F.sum(p).alias(p) for p in own]).collect()  # a row per language and one for null
    weight = {r["declared"]: np.array([r[p] or 0.0 for p in own]) for r in sums}
    by_declared = np.stack([weight.get(d, np.zeros(n)) for d in languages])
    overall = sum(weight.values(), np.ones(n))
    said = np.log((by_declared + DECLARED_DRAW / n) / (by_declared.sum(axis=0) + DECLARED_DRAW))

    # address levels: sums by host, then by domain and suffix from the hosts' sums
    hosts = scored.groupBy("host").agg(*[F.sum(p).alias(f"h{i}") for i, p in enumerate(own)])
    labels = F.split("host", r"\.")
    hosts = staged(hosts.withColumns({"domain": F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), "."), "suffix": F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise("")}), "hosts")
    for level, short in (("domain", "d"), ("suffix", "x")):
        hosts = hosts.join(hosts.groupBy(level).agg(*[F.sum(f"h{i}").alias(f"{short}{i}") for i in range(n)]), level)
    met = scored.join(hosts.select("host", *[f"{c}{i}" for c in "hdx" for i in range(n)]), "host")
    out = f"doc_id {id_type}, language string, confidence double, accepted boolean, text_language string, letters bigint"
    return met.drop("host").mapInArrow(_fuse(said, overall / overall.sum(), languages, accept), out)


def of_documents(docs: DataFrame) -> DataFrame:
    """``identify`` over documents: ``lang`` is the declared language and ``source`` the host."""
    return identify(docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host")))


def of_pages(pages: DataFrame) -> DataFrame:
    """``identify`` over raw pages, as page_id: visible text, ``html lang`` and the URL's host."""
    html = F.coalesce("html", F.lit(""))
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    lang = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z-]+)""", 1)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return identify(pages.select(F.col("page_id").alias("doc_id"), visible.alias("text"), lang.alias("declared"), host.alias("host"))).withColumnRenamed("doc_id", "page_id")


def keep_accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is accepted; rows that share a doc_id stay if one of them is accepted."""
    stay = of_documents(docs).filter("accepted").select(F.col("doc_id").alias("_li_id")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["_li_id"]), "left_semi")
