"""Secret scanning: fixed patterns, and a linear-chain conditional random field for what they miss.

Tokens are runs of value characters (letters, digits, ``+/_.-``, any non-ASCII character) and runs of other non-space
characters; each is tagged as beginning a secret, inside one, or outside. Emissions sum hashed features: the token's
shape (length, share of digits, cases, hexadecimal, switches between letters and digits), the token itself, its
neighbours and their shapes, and the file's share of digits and punctuation. Transitions are free weights.

The field learns from the patterns: a hash sample of about ``FIT_DOCS`` texts with a match and as many without, cut to
``FIT_WINDOW`` tokens around a match or around a hashed place, by AdaGrad on the exact log-likelihood (forward-backward).
All texts are then decoded whole. Decoding is exact Viterbi: a token whose emission prefers ``outside`` by more than any
neighbouring labels can make up for is outside on every best path, so the chain falls apart there and only the
runs in between are decoded, all runs of a block in step.

Spans of the field that touch a pattern's span are left out; the patterns' spans always stay.

Defined cases: a null text is empty; texts are read whole; equal spans of several kinds are all listed, by start, then
in the order assign, access, hex, crf. Repeated rows get equal results. Without any pattern match in the table there is
nothing to learn and only the patterns count. Extra columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.llm.columnar import LOWERED, SPACE, blocks, span_hashes, text_bytes
from hanok.llm.tables import staged

#: The patterns, the least length of what counts, and the part that is measured.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
KINDS = {name: i for i, (name, *_) in enumerate(PATTERNS)} | {"crf": len(PATTERNS)}
#: Every text with a match contains one of these (RE2 and Java).
SIGN = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{24}"
#: Exactly the texts with a match (Java).
MATCH = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}"""

OUT, BEGIN, INSIDE = 0, 1, 2
TABLE, FIT_DOCS, FIT_WINDOW, EPOCHS, RATE, DECAY = 1 << 14, 400, 96, 40, 0.3, 1e-3
BLOCK, NAMED = 1 << 22, 12


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind."""
    found = [(*m.span(), kind) for kind, pattern, part, least in PATTERNS for m in pattern.finditer(text) if m.end(part) - m.start(part) >= least]
    return sorted(found, key=lambda s: (s[0], KINDS[s[2]]))


_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_SMALL = (_BYTE >= 97) & (_BYTE <= 122)
_WIDE = _BYTE >= 128
_HEX = _DIGIT | ((_BYTE >= 97) & (_BYTE <= 102))
_KIND = np.where(SPACE, 0, np.where(_DIGIT | _UPPER | _SMALL | _WIDE | np.isin(_BYTE, list(b"+/_.-")), 1, 2)).astype(np.uint8)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every token."""
    kind = _KIND[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    cuts = offsets[:-1]
    new[cuts[cuts < len(data)]] = True
    edges = np.flatnonzero(new)
    ends = np.append(edges[1:], len(data))
    real = kind[edges] > 0
    starts = edges[real]
    return starts, ends[real], np.searchsorted(offsets, starts, side="right") - 1


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows of the weight table, nine for each token."""
    size = ends - starts

    def many(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(mask, out=sums[1:])
        return sums[ends] - sums[starts]

    digits, hexes, upper, small, wide = (many(m[data]) for m in (_DIGIT, _HEX, _UPPER, _SMALL, _WIDE))
    switch = np.zeros(len(data), bool)
    switch[1:] = _DIGIT[data[1:]] != _DIGIT[data[:-1]]
    switches = np.minimum(many(switch), 15) >> 1
    long = np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), 7)
    share = np.where(digits == 0, 0, np.where(digits == size, 1, 2 + np.minimum(3 * digits // np.maximum(size, 1), 2)))
    mark = (_KIND[data[starts]] == 2).astype(np.int64)
    shape = ((((long * 5 + share) * 2 + (upper > 0)) * 2 + (small > 0)) * 2 + (hexes == size)) * 2 + (wide > 0)
    shape = (shape * 2 + mark).astype(np.uint64)
    rough = ((((np.minimum(long, 4) * 5 + share) * 2 + (upper > 0)) * 2 + (small > 0)) * 2 + (hexes == size)) * 2 + mark
    rough = rough.astype(np.uint64)
    own = np.where(size <= NAMED, span_hashes(LOWERED[data], starts, ends), 0)  # longer tokens recur too rarely to be learnt

    def moved(x: np.ndarray, k: int) -> np.ndarray:
        """The value k tokens before (after, if negative) in the same text, else 0."""
        out = np.zeros_like(x)
        if 0 < k < len(x):
            out[k:] = np.where(text[k:] == text[:-k], x[:-k], 0)
        elif k < 0 and -k < len(x):
            out[:k] = np.where(text[:k] == text[-k:], x[-k:], 0)
        return out

    n = int(text[-1]) + 1 if len(text) else 0
    total = np.maximum(np.bincount(text, minlength=n), 1)
    file = (np.bincount(text, weights=digits > 0, minlength=n) * 8 // total).astype(np.uint64) * np.uint64(9) + (np.bincount(text, weights=mark, minlength=n) * 8 // total).astype(np.uint64)
    parts = [
        shape, own, moved(own, 1), moved(own, 2), moved(own, -1), rough, rough * np.uint64(65537) + moved(rough, 1),
        rough * np.uint64(65543) + file[text] if n else rough, np.minimum(long, 4).astype(np.uint64) * np.uint64(64) + switches.astype(np.uint64),
    ]
    with np.errstate(over="ignore"):
        return np.stack([(((p + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(k * 0x51ED2701)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(50)).astype(np.int32) for k, p in enumerate(parts)], axis=1)


def emissions(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = weights[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        out = out + weights[rows[:, k]]
    return out


def viterbi(emit: np.ndarray, step: np.ndarray, runs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of runs of tokens (first token, length), all between two ``outside`` labels, in step with each other."""
    order = np.argsort(-lengths, kind="stable")
    first, size = runs[order], lengths[order]
    labels = np.zeros(len(emit), np.int8)
    back = np.zeros((len(emit), 3), np.int8)
    if not len(first):
        return labels
    best = step[OUT] + emit[first]
    for k in range(1, int(size[0])):
        live = int(np.searchsorted(-size, -k, side="left"))  # runs longer than k
        reach = best[:live, :, None] + step[None]
        back[first[:live] + k] = reach.argmax(axis=1)
        best[:live] = reach.max(axis=1) + emit[first[:live] + k]
    at = (best + step[:, OUT]).argmax(axis=1)
    for k in range(int(size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-size, -k, side="left"))
        place = first[:live] + k
        labels[place] = at[:live]
        if k:
            at[:live] = back[place, at[:live]]
    return labels


def decode(weights: np.ndarray, step: np.ndarray, rows: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Labels of the best path of every text; a text begins and ends outside."""
    emit = emissions(weights, rows)
    gain = max(step[a, y] + step[y, b] - step[a, OUT] - step[OUT, b] for a in range(3) for b in range(3) for y in (BEGIN, INSIDE))
    open_ = emit[:, OUT] - np.maximum(emit[:, BEGIN], emit[:, INSIDE]) <= max(gain, 0.0)
    at = np.flatnonzero(open_)
    if not len(at):
        return np.zeros(len(emit), np.int8)
    begins = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])])
    runs = at[begins]
    return viterbi(emit, step, runs, np.diff(np.append(np.flatnonzero(begins), len(at))))


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions from (feature rows, labels) sequences, by AdaGrad on the log-likelihood."""
    weights, step = np.zeros((TABLE, 3)), np.zeros((3, 3))
    if not sequences:
        weights[:, OUT] = 1.0
        return weights, step
    sequences = sorted(sequences, key=lambda s: -len(s[1]))
    size = np.array([len(y) for _, y in sequences])
    first = np.cumsum(size) - size
    rows, want = np.concatenate([r for r, _ in sequences]), np.concatenate([y for _, y in sequences])
    flat = rows.reshape(-1)
    seen, seen_step = np.full(weights.shape, 1.0), np.full((3, 3), 1.0)
    real = np.zeros((3, 3))
    for a, n in zip(first, size, strict=True):
        y = np.concatenate([[OUT], want[a : a + n], [OUT]])
        np.add.at(real, (y[:-1], y[1:]), 1)

    def join(x):  # log-sum over the axis of the label before
        top = x.max(axis=1, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]

    for _ in range(epochs):
        emit = emissions(weights, rows)
        ahead, after = np.zeros_like(emit), np.zeros_like(emit)
        ahead[first] = step[OUT] + emit[first]
        for k in range(1, int(size[0])):
            live = first[: int(np.searchsorted(-size, -k, side="left"))] + k
            ahead[live] = join(ahead[live - 1][:, :, None] + step[None]) + emit[live]
        after[first + size - 1] = step[:, OUT]
        for k in range(int(size[0]) - 2, -1, -1):
            live = first[: int(np.searchsorted(-size, -(k + 1), side="left"))] + k
            after[live] = join((after[live + 1] + emit[live + 1])[:, :, None] + step.T[None])
        whole = ahead + after
        top = whole.max(axis=1, keepdims=True)
        norm = np.log(np.exp(whole - top).sum(axis=1, keepdims=True)) + top
        chance = np.exp(whole - norm)
        inner = np.setdiff1d(np.arange(len(want)), first)
        pair = np.exp(ahead[inner - 1][:, :, None] + step[None] + (emit[inner] + after[inner])[:, None, :] - norm[inner][:, :, None]).sum(axis=0)
        pair[OUT] += chance[first].sum(axis=0)
        pair[:, OUT] += chance[first + size - 1].sum(axis=0)
        slope = chance
        slope[np.arange(len(want)), want] -= 1
        for y in range(3):
            g = np.bincount(flat, weights=np.repeat(slope[:, y], rows.shape[1]), minlength=TABLE) + DECAY * weights[:, y]
            seen[:, y] += g * g
            weights[:, y] -= RATE * g / np.sqrt(seen[:, y])
        g = pair - real
        seen_step += g * g
        step -= RATE * g / np.sqrt(seen_step)
    return weights, step


def _values(text: str) -> list[tuple[int, int]]:
    """The measured parts of all matches, in code points."""
    return sorted({(m.start(part), m.end(part)) for _, pattern, part, least in PATTERNS for m in pattern.finditer(text) if m.end(part) - m.start(part) >= least})


def _variants(text: str, seed: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """The text with its matches, and, so that the field does not merely learn the patterns by heart, the text around the
    first match with a shorter value behind another name."""
    values = _values(text)
    yield text, values
    if values:
        a, b = values[0]
        before = text[max(0, a - 2_000) : a]
        name = before.split()[seed % len(before.split())] if before.split() else ""
        renamed = PATTERNS[0][1].sub(lambda m: m.group().replace(m[1], name, 1), before + text[a:b])[: -(b - a)]
        short = text[a : a + min(b - a, 16 + seed % 25)]
        yield renamed + short + text[b : b + 2_000], [(len(renamed), len(renamed) + len(short))]


def _window(text: str, values: list[tuple[int, int]], seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Features and labels of the tokens around the first value, or around a hashed place."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, of = tokens(data, np.array([0, len(data)]))
    if not len(starts):
        return None
    rows, labels = features(data, starts, ends, of), np.zeros(len(starts), np.int8)
    place = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(data)]])  # byte of each code point
    for a, b in values:
        inside = np.flatnonzero((starts < place[b]) & (ends > place[a]))
        if len(inside) and not labels[inside].any():
            labels[inside], labels[inside[0]] = INSIDE, BEGIN
    marked = np.flatnonzero(labels)
    centre = marked[0] if len(marked) else seed % len(starts)
    a = max(0, centre - FIT_WINDOW // 2)
    return rows[a : a + FIT_WINDOW], labels[a : a + FIT_WINDOW]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of drawn texts, as arrays in bytes: texts themselves stay in the tasks."""

    def packed(array: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.save(out, array, allow_pickle=False)
        return out.getvalue()

    for batch in batches:
        made = []
        for r in batch.to_pylist():
            seed = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:8], 16)
            found = [_window(text, values, seed) for text, values in _variants(r["text"] or "", seed)]
            made += [(r["u"], i, packed(w[0]), packed(w[1])) for i, w in enumerate(found) if w]
        columns = zip(*made, strict=True) if made else [[]] * 4
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["u", "i", "rows", "labels"])


def drawn(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(u, i, rows, labels): windows of at most ``fit_docs`` rows with a match and as many without, drawn by a hash of the whole
    row, so that repeated or null ids are drawn apart."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("u", F.xxhash64("doc_id", "text", F.lit("secrets")))
    # the smallest hashes are found among hashes; only their rows' texts travel, one of equal ones
    marked = staged(rows.select("u", F.col("text").rlike(MATCH).alias("match")), "matches")
    least = [marked.filter(c).select("u").distinct().orderBy("u").limit(fit_docs) for c in ("match", "not match")]
    few = F.broadcast(least[0].unionByName(least[1]))  # 2 * fit_docs hashes
    chosen = rows.join(few, "u", "left_semi").dropDuplicates(["u"])
    return chosen.mapInArrow(_windows, "u bigint, i int, rows binary, labels binary")


def learn(docs: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """The field's weights and transitions from :func:`drawn` windows of ``docs(doc_id, text)``."""
    unpacked = lambda data: np.load(io.BytesIO(data), allow_pickle=False)
    found = sorted(((r.u, r.i, bytes(r.rows), bytes(r.labels)) for r in drawn(docs, fit_docs).collect()))
    windows = [(unpacked(rows), unpacked(labels)) for _, _, rows, labels in found]
    return fit(windows if any(labels.any() for _, labels in windows) else [])


def _scan(weights: np.ndarray, step: np.ndarray):
    weights = weights.astype(np.float32)

    def added(batch: pa.RecordBatch) -> dict[int, list[tuple[int, int, str]]]:
        """Spans of the field by row, in code points of the text."""
        out: dict[int, list] = {}
        data, offsets = text_bytes(batch.column("text"))
        for a, b in blocks(offsets, BLOCK):
            part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, ends, text = tokens(part, cuts)
            if not len(starts):
                continue
            labels = decode(weights, step, features(part, starts, ends, text), text)
            hit = np.flatnonzero(labels)
            if not len(hit):
                continue
            chars = np.zeros(len(part) + 1, np.int64)
            np.cumsum((part & 0xC0) != 0x80, out=chars[1:])
            new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (labels[hit[1:]] == BEGIN) | (text[hit[1:]] != text[hit[:-1]])])
            lasts = np.append(hit[np.flatnonzero(new)[1:] - 1], hit[-1])
            for i, j in zip(hit[new], lasts, strict=True):
                zero = chars[cuts[text[i]]]
                out.setdefault(a + int(text[i]), []).append((int(chars[starts[i]] - zero), int(chars[ends[j]] - zero), "crf"))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            signs = pc.match_substring_regex(texts, SIGN).to_pylist()
            more = added(batch)
            rows = []
            for i, sign in enumerate(signs):
                base = base_spans(texts[i].as_py()) if sign else []
                extra = [s for s in more.get(i, []) if all(s[1] <= a or b <= s[0] for a, b, _ in base)]
                listed = ["%s:%d:%d" % (k, a, b) for a, b, k in base]
                every = sorted(base + extra, key=lambda s: (s[0], KINDS[s[2]]))
                counts = [sum(k == name for _, _, k in every) for name in KINDS]
                rows.append((*counts, hashlib.sha256(",".join(listed).encode()).hexdigest(), ",".join("%s:%d:%d" % (k, a, b) for a, b, k in every)))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"])

    return run


def scan(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans), one row per row of ``docs(doc_id, text)``."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    weights, step = learn(rows, fit_docs)
    id_type = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_scan(weights, step), f"doc_id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, n_crf bigint, base_sha256 string, spans string")
