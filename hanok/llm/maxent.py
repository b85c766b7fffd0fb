"""Language-model scoring with a hashed maximum-entropy model.

A text is its words (A-Z lower-cased) and one end token. The next token is predicted in two factors: its class by a softmax
over hashed features of the words before it (the word before, the pair before, and the second and third word back on
their own), and the token within its class by smoothed counts. The classes are the end token, the ``TOP`` most
frequent words, each on its own, and ``CLASSES - TOP - 1`` classes of all other words by their last two bytes, so that
every word has a class, seen or not.

Counts are exact sums over all training texts. The class weights are trained by distributed gradient updates: in each of
``ROUNDS`` rounds every task runs AdaGrad over its share of the training texts (each text is in one round), and the
tasks' weights are averaged, block of rows by block of rows, in a shuffle. The model has a fixed size. Scoring works in
numpy batches of ``BATCH`` tokens. Counts of the most frequent tokens, at most ``FREQUENT``, go to the tasks; the tokens
beyond are joined with their counts by a shuffle, one row per text and distinct token.

A token's identity is a 64-bit hash of its bytes (two of a billion distinct tokens collide with a chance of 3 %).

Defined cases: null and empty texts are the end token alone; texts are read whole; a null doc_id has the remainder of the
empty text (0) and trains. Rows are scored on their own, repeated ids included, and every training row is counted. Without
training texts N = V = 0 and all classes are equally likely. Extra columns play no part. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.llm.columnar import LOWERED, blocks, span_hashes, text_bytes, words
from hanok.llm.tables import staged

ROWS, CLASSES, TOP = 1 << 13, 64, 31
ROUNDS, BATCH, RATE = 2, 16_384, 0.15
CHUNK, SHORT = 1024, 8
FREQUENT = 1 << 18
BLOCK = 1 << 22
WEIGHT_BLOCK = 128
END, START = np.uint64(0x5BD1E995C0FFEE01), np.uint64(0x27D4EB2F165667C5)


@dataclass
class Tokens:
    """Tokens of a block of texts, ends included: hash, class outside the top words, text number, first token of each text."""

    hashes: np.ndarray
    tail: np.ndarray
    text: np.ndarray
    first: np.ndarray


def tokenize(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    low = LOWERED[data]
    starts, ends, of = words(low, offsets)
    n = len(offsets) - 1
    counts = np.bincount(of, minlength=n) + 1
    first = np.cumsum(counts) - counts
    at = np.arange(len(of)) + of
    hashes = np.full(len(of) + n, END, np.uint64)
    hashes[at] = span_hashes(low, starts, ends)
    last = low[ends - 1].astype(np.int64) * 256 + low[np.maximum(ends - 2, starts)]
    tail = np.zeros(len(hashes), np.int16)
    tail[at] = TOP + 1 + (last * 40503 >> 4) % (CLASSES - TOP - 1)
    return Tokens(hashes, tail, np.repeat(np.arange(n), counts), first)


def features(t: Tokens) -> np.ndarray:
    """Rows of the weight table, four for each token."""
    place = np.arange(len(t.hashes)) - t.first[t.text]
    back = []
    for k in (1, 2, 3):
        h = np.full(len(t.hashes), START, np.uint64)
        h[k:] = t.hashes[:-k] if len(t.hashes) > k else 0
        h[place < k] = START
        back.append(h)
    one, two, three = back
    with np.errstate(over="ignore"):
        mixed = [one * np.uint64(0x9E3779B97F4A7C15), (one ^ (two >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F) + two, two * np.uint64(0x165667B19E3779F9), three * np.uint64(0xD6E8FEB86659FD93)]
    return np.stack([(m >> np.uint64(40)).astype(np.int64) % ROWS for m in mixed], axis=1)


def classes(t: Tokens, top: np.ndarray) -> np.ndarray:
    """Class of each token; ``top`` holds the sorted hashes of the top words."""
    out = t.tail.astype(np.int64)
    if len(top):
        at = np.minimum(np.searchsorted(top, t.hashes), len(top) - 1)
        out = np.where((top[at] == t.hashes) & (t.tail > 0), at + 1, out)
    return out


def class_scores(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Natural log-probability of every class, ``CHUNK`` tokens at a time. The last row of the weights is the bias."""
    out = np.empty((len(rows), weights.shape[1]), weights.dtype)
    for s in range(0, len(rows), CHUNK):
        z, r = out[s : s + CHUNK], rows[s : s + CHUNK]
        np.add(weights.take(r[:, 0], axis=0), weights[-1], out=z)
        for k in range(1, r.shape[1]):
            z += weights.take(r[:, k], axis=0)
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return out


def group_sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the groups of rows that begin at ``cuts``: short groups row by row in step, each long one on its own (numpy's
    own grouped sum is several times slower along rows)."""
    sizes = np.diff(np.append(cuts, len(values)))
    out = values[cuts]
    for k in range(1, SHORT):
        more = np.flatnonzero((sizes > k) & (sizes <= SHORT))
        out[more] += values[cuts[more] + k]
    for g in np.flatnonzero(sizes > SHORT):
        out[g] = values[cuts[g] : cuts[g] + sizes[g]].sum(axis=0)
    return out


def _tokens(batch: pa.RecordBatch):
    data, offsets = text_bytes(batch.column("text"))
    for a, b in blocks(offsets, BLOCK):
        yield a, b, tokenize(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, t in _tokens(batch):
            h, at, n = np.unique(t.hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t.tail[at].astype(np.int32)), pa.array(n)], names=["token", "tail", "n"])


def token_counts(training: DataFrame) -> DataFrame:
    """(token, tail, n): exact count of every distinct token of ``training(text)``."""
    return training.select("text").mapInArrow(_count, "token bigint, tail int, n bigint").groupBy("token").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


def _train(weights: np.ndarray, top: np.ndarray):
    def update(w: np.ndarray, seen: np.ndarray, rows: np.ndarray, want: np.ndarray) -> None:
        slope = class_scores(w, rows)
        np.exp(slope, out=slope)
        slope[np.arange(len(want)), want] -= 1
        for k in range(rows.shape[1]):
            order = np.argsort(rows[:, k].astype(np.uint16), kind="stable")
            row = rows[order, k]
            cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            step, row = group_sums(slope.take(order, axis=0), cut), row[cut]
            seen[row] += step * step
            w[row] -= RATE * step / np.sqrt(seen[row])
        step = slope.sum(axis=0)
        seen[-1] += step * step
        w[-1] -= RATE * step / np.sqrt(seen[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, seen, used = weights.copy(), np.full_like(weights, 1.0), 0
        for batch in batches:
            for _, _, t in _tokens(batch):
                rows, want = features(t), classes(t, top)
                used += len(want)
                for s in range(0, len(want), BATCH):
                    update(w, seen, rows[s : s + BATCH], want[s : s + BATCH])
        if used:
            parts = range(0, len(w), WEIGHT_BLOCK)
            values = [w[p : p + WEIGHT_BLOCK].astype(np.float32).tobytes() for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([float(used)] * len(values)), pa.array(values, pa.binary())], names=["part", "used", "w"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for x in batch.to_pylist():
            held = sums.setdefault(x["part"], [0.0, 0.0])
            held[0] = held[0] + x["used"] * np.frombuffer(x["w"], np.float32).astype(np.float64)
            held[1] += x["used"]
    if sums:
        values = [(s / n).astype(np.float32).tobytes() for s, n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(values, pa.binary())], names=["part", "w"])


def train(training: DataFrame, top: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Class weights, a row per hashed feature and the bias last; the averaged table alone comes to the driver."""
    weights = np.zeros((ROWS + 1, CLASSES), np.float32)
    for k in range(rounds):
        share = training.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k).select("text")
        mean = share.mapInArrow(_train(weights, top), "part int, used double, w binary").repartition("part").mapInArrow(_average, "part int, w binary")
        new = weights.copy()
        for r in mean.collect():
            new[r["part"] : r["part"] + WEIGHT_BLOCK] = np.frombuffer(r["w"], np.float32).reshape(-1, CLASSES)
        weights = new
    return weights


def _score(weights: np.ndarray, top: np.ndarray, known: np.ndarray, known_n: np.ndarray, room: np.ndarray):
    """``known``, ``known_n``: sorted frequent tokens and their counts; ``room``: log10 of each class's count total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((5, batch.num_rows))
            rest, many, sizes = [], [], np.zeros(batch.num_rows, np.int64)
            for a, b, t in _tokens(batch):
                n = b - a
                rows, cls = features(t), classes(t, top)
                chance = np.empty(len(cls))
                for s in range(0, len(cls), BATCH):
                    part = slice(s, s + BATCH)
                    chance[part] = class_scores(weights, rows[part])[np.arange(len(cls[part])), cls[part]]
                at = np.minimum(np.searchsorted(known, t.hashes), max(len(known) - 1, 0))
                hit = known[at] == t.hashes if len(known) else np.zeros(len(cls), bool)
                count = np.log10(np.where(hit, known_n[at] if len(known) else 0, 0) + 1.0)
                others = cls > TOP
                within = np.where(others, count - room[cls], 0.0)
                for k, x in enumerate((np.ones(len(cls)), hit, count, chance / np.log(10), within)):
                    sums[k, a:b] = np.bincount(t.text, weights=x, minlength=n)
                left = np.flatnonzero(~hit)
                left = left[np.lexsort((t.hashes[left], t.text[left]))]
                h, of = t.hashes[left], t.text[left]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])) if len(h) else np.zeros(0, np.int64)
                rest.append(h[new])
                many.append(np.diff(np.append(new, len(h))))
                sizes[a:b] = np.bincount(of[new], minlength=n)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())) for x in ([r.view(np.int64) for r in rest], many)]
            whole = [pa.array(s.astype(np.int64)) for s in sums[:2]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "doc_id", "held_out")], *whole, *[pa.array(s) for s in sums[2:]], *lists], names=["row", "doc_id", "held_out", "n_tokens", "hits", "base", "chance", "within", "rest", "many"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs(doc_id, text)``.

    ``base_score`` is the add-one unigram log10-probability, ``score`` that of the model; both learn from the rows whose
    crc32 of the id leaves another remainder than 2 modulo 7.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held.alias("held_out"))
    training = rows.filter("not held_out")
    counts = staged(token_counts(training), "token-counts")

    top_rows = counts.filter("tail > 0").orderBy(F.desc("n"), "token").limit(TOP).collect()
    top = np.sort(np.array([r["token"] for r in top_rows], np.int64).view(np.uint64))
    top_words = [int(x) for x in top.view(np.int64)]
    by_class = counts.withColumn("tail", F.when(F.col("token").isin(top_words), 0).otherwise(F.col("tail")) if top_words else F.col("tail"))
    totals = by_class.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # a row per class
    n_all, v_all = sum(r["n"] for r in totals), sum(r["v"] for r in totals)
    room = np.zeros(CLASSES)
    for r in totals:
        room[r["tail"]] = np.log10(r["n"] + r["v"] + 1)

    # frequent tokens: the lowest power of two above which at most FREQUENT tokens lie
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("v")).collect()
    power, room_left = 64, FREQUENT
    for r in sorted(sizes, key=lambda r: -r["power"]):
        if r["v"] > room_left:
            break
        power, room_left = r["power"], room_left - r["v"]
    single = [*top_words, int(np.array([END]).view(np.int64)[0])]  # tokens that are classes of their own are always at hand
    frequent = counts.filter((F.floor(F.log2("n")) >= power) | F.col("token").isin(single)).select("token", "n").toPandas()
    known = frequent["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    weights = train(training, top)

    id_type = dict(rows.dtypes)["doc_id"]
    schema = f"row bigint, doc_id {id_type}, held_out boolean, n_tokens bigint, hits bigint, base double, chance double, within double, rest array<bigint>, many array<bigint>"
    run = _score(weights, top, known[order], frequent["n"].to_numpy(np.int64)[order], room)
    scored = staged(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema), "token-scores")
    rest = scored.select("row", F.explode(F.arrays_zip("rest", "many")).alias("x")).select("row", F.col("x.rest").alias("token"), F.col("x.many").alias("many"))
    met = rest.join(counts.select("token", "n"), "token")
    found = met.groupBy("row").agg(F.sum(F.col("many") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("many").alias("more_hits"))
    whole = scored.drop("rest", "many").join(found, "row", "left").na.fill(0, ["more", "more_hits"])
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hits") + F.col("more_hits")).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.col("more") - F.col("n_tokens") * float(np.log10(n_all + v_all + 1))).alias("base_score"),
        (F.col("chance") + F.col("within") + F.col("more")).alias("score"),
    )
