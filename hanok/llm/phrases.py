"""Phrases of words that occur together more often than their parts explain, mined by Toivonen's method.

A phrase is a run of words within one piece of a text (pieces end at punctuation and line ends). It can only be frequent if
the two phrases one word shorter in it are. So:

1. A sample of the documents proposes, for each language, the words and shorter phrases that may be frequent.
2. One pass over all documents counts exactly what the sample proposes and its negative border: all words, and every phrase
   whose two shorter phrases were proposed, whether it was itself proposed or not.
3. Words and phrases that prove frequent without having been proposed are failures of the border: phrases built on them were
   not counted. A further pass counts these, for each length, until no failure is left.

The sample and the filters therefore only choose in which pass a phrase is counted; the counts are whole.

What was proposed is handed to the tasks as a bitmap of at most ``2 ** MOST_BITS`` bits over phrase hashes; what collides in it
is counted in addition, which does no harm. Tasks count their blocks in numpy before anything is shuffled, so a frequent word
or phrase is one row per block. Words and languages travel as 64-bit hashes, under another seed if a second hash shows that two words of
a language share one; a last pass spells the words of the phrases that are reported.

Defined cases: A-Z are lower-cased; a null text has no word; a null language is ``und``; texts are read whole; repeated rows
and ids count each time; extra columns play no part; an empty table has no phrase.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hanok.llm.columnar import LOWERED, _splitmix, blocks, ranges, span_hashes, text_bytes
from hanok.llm.tables import staged

LEAST, LONGEST, TOP, CONTAINED, UNKNOWN = 10, 3, 2_000, 50, "und"
#: One document in so many is in the sample, in which a word or phrase is proposed if it occurs so often.
SAMPLE, PROPOSED = 4, 3
#: Bitmaps have 8 bits for each phrase handed over, and at most 2^27 (16 MB).
BITS_EACH, MOST_BITS = 8, 27
#: Bytes of text read at a time, and words counted at a time.
BLOCK, GATHER = 1 << 20, 1 << 19
#: Bits of a bitmap that one task sets.
STRIP = 1 << 18
#: Fixed by the contract: what parts words, and what ends a piece.
PARTS, STOPS = b"\x20\x09", b".,;:!?\n\x0b\x0c\r"
_SPLIT = np.zeros(256, bool)
_SPLIT[list(PARTS + STOPS)] = True
_STOP = np.zeros(256, bool)
_STOP[list(STOPS)] = True
PLACE = _splitmix(np.arange(1, 17, dtype=np.uint64) + np.uint64(1 << 34)) | np.uint64(1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text, piece) of every word of lower-cased texts; a piece has one number over all texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # texts begin and end
    inside = ~_SPLIT[data]
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    cuts = np.cumsum(_STOP[data] | edge[:-1])
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, cuts[starts]


def combined(words: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each phrase, given by the hashes of its words and its language; never the word's own for one word."""
    with np.errstate(over="ignore"):
        out = _splitmix(lang + PLACE[-1])
        for i, w in enumerate(words):
            out = out + _splitmix(w.astype(np.uint64) + PLACE[i]) * PLACE[i]
        return _splitmix(out)


class Members:
    """A bitmap of phrase hashes (h), shared with the tasks."""

    def __init__(self, hashes: DataFrame):
        self.bits = min(MOST_BITS, max(18, (BITS_EACH * hashes.count()).bit_length()))
        strip = min(STRIP, 1 << self.bits)
        place = F.shiftrightunsigned(F.col("h"), 64 - self.bits).alias("at")
        strips = hashes.select(place).repartition(F.expr(f"at div {strip}")).mapInArrow(_strips(strip), "strip bigint, bits binary")
        bitmap = np.zeros(1 << (self.bits - 3), np.uint8)
        for row in strips.collect():  # MOST_BITS bound what it brings
            bitmap[row.strip * (strip // 8) : (row.strip + 1) * (strip // 8)] |= np.frombuffer(row.bits, np.uint8)
        self.shared = hashes.sparkSession.sparkContext.broadcast(bitmap)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

    def close(self) -> None:
        self.shared.destroy()


def _strips(strip: int):
    """The bits of whole strips; a strip's places lie in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column("at").to_numpy()
            for number in np.unique(at // strip).tolist():
                made.setdefault(number, np.zeros(strip, bool))[at[at // strip == number] % strip] = True
        packed = [np.packbits(b).tobytes() for b in made.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array(packed, pa.binary())], names=["strip", "bits"])

    return run


def _grouped(key: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each group of equal rows, its size); ``key`` is a hash of the columns."""
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    differ = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    if (differ & ~new[1:]).any():  # rows of one hash that are not equal
        order = np.lexsort(columns)
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[ranges(starts, ends - starts)]))


def _of_lang(name: str) -> int:
    data = np.frombuffer(name.encode(), np.uint8)
    return int(span_hashes(data, np.zeros(1, np.int64), np.array([len(data)]))[0])


def _read(batches: Iterator[pa.RecordBatch], seed: int):
    """Block by block: the lower-cased bytes, start, end and piece of each word, its hash (never 0), the number and hash of its
    language, and the languages."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        of_lang = np.array([_of_lang(v) for v in langs.dictionary.to_pylist()], np.uint64)
        data, offsets = text_bytes(batch.column("text"))
        for a, z in blocks(offsets, BLOCK):
            low = LOWERED[data[offsets[a] : offsets[z]]]
            starts, ends, text, piece = tokens(low, offsets[a : z + 1] - offsets[a])
            if len(starts):
                raw = span_hashes(low, starts, ends)
                word = np.maximum(_splitmix(raw + np.uint64(seed)), np.uint64(1))
                lang = langs.indices.to_numpy()[a:z][text]
                yield low, starts, ends, piece, word, raw, lang, of_lang[lang], langs.dictionary


def _gathered(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[list[np.ndarray]]:
    """Hash, language, piece, raw hash and bytes of many words at a time."""
    held: list[list[np.ndarray]] = []
    words = pieces = 0
    for _, starts, ends, piece, word, raw, _, lang, _ in _read(batches, seed):
        held.append([word, lang, piece + pieces, raw, ends - starts])
        words += len(word)
        pieces += int(piece[-1]) + 1
        if words >= GATHER:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, words, pieces = [], 0, 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _counter(seed: int, lengths: Sequence[int], asked: dict[int, tuple[Members, Members | None]], longest: int):
    """Counts of the phrases of some lengths: of one word all, of k words those whose two shorter phrases are members of
    ``asked[k - 1][0]`` and not both of ``asked[k - 1][1]``, an earlier pass's. Of a word also its second hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for word, lang, piece, raw, size in _gathered(batches, seed):
            for k in lengths:
                at = np.arange(max(0, len(word) - k + 1))
                if k > 1:
                    at = at[piece[at] == piece[at + k - 1]]
                    first, second = (combined([word[at + i + j] for j in range(k - 1)], lang[at]) for i in (0, 1))
                    members, earlier = asked[k - 1]
                    keep = members.has(first) & members.has(second)
                    if earlier is not None:
                        keep &= ~(earlier.has(first) & earlier.has(second))
                    at = at[keep]
                if not len(at):
                    continue
                words = [word[at + j] for j in range(k)]
                row, count = _grouped(combined(words, lang[at]), [*words, lang[at]])
                none = np.zeros(len(row), np.uint64)
                second = _splitmix(raw[at[row]] * PLACE[0] ^ size[at[row]].astype(np.uint64) * PLACE[1]) if k == 1 else none
                columns = [lang[at[row]], *(words[j][row] if j < k else none for j in range(longest)), count, second]
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=[*_names(longest), "f", "check"])

    return run


def _speller(seed: int, members: Members):
    """(lang, g, w0, word, n): for each block its languages with their number of words, and its words among the members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for low, starts, ends, _, word, _, lang, hashed, names in _read(batches, seed):
            n = np.bincount(lang, minlength=len(names))
            some = np.flatnonzero(n)
            first = np.full(len(names), len(lang))
            np.minimum.at(first, lang, np.arange(len(lang)))
            columns = [names.take(pa.array(some)), pa.array(hashed[first[some]].view(np.int64)), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.string()), pa.array(n[some])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "g", "w0", "word", "n"])
            key = combined([word], hashed)
            at = np.flatnonzero(members.has(key))
            if len(at):
                at = at[_grouped(key[at], [word[at], hashed[at]])[0]]
                columns = [names.take(pa.array(lang[at])), pa.array(hashed[at].view(np.int64)), pa.array(word[at].view(np.int64)), _spelled(low, starts[at], ends[at]), pa.nulls(len(at), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "g", "w0", "word", "n"])

    return run


def _names(k: int, first: int = 0) -> list[str]:
    return ["g", *(f"w{i}" for i in range(first, first + k))]


def _hashes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, *words = (batch.column(c).to_numpy().view(np.uint64) for c in _names(k))
            yield pa.RecordBatch.from_arrays([pa.array(combined(words, g).view(np.int64))], names=["h"])

    return run


def _members(phrases: Sequence[DataFrame], k: int) -> Members:
    """The bitmap of these tables of k-word phrases."""
    rows = reduce(DataFrame.unionByName, [p.select(*_names(k)) for p in phrases])
    return Members(staged(rows.mapInArrow(_hashes(k), "h bigint"), "phrase-members"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))


@dataclass
class Counts:
    """``frequent[k]`` (g, w0, ..., f): all phrases of k words that occur often enough, by the hashes of language and words under
    ``seed``; ``passes``: the lengths counted in each pass over all documents."""

    frequent: dict[int, DataFrame]
    passes: list[tuple[int, ...]]
    seed: int


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: int = SAMPLE, proposed: int = PROPOSED, seed: int = 1) -> Counts:
    """Exact counts of all phrases of at most ``longest`` words of ``docs(lang, text)`` that occur at least ``least`` times."""
    rows = _texts(docs)
    lengths = tuple(range(1, longest + 1))
    schema = ", ".join(f"{c} bigint" for c in [*_names(longest), "f", "check"])

    def counted(table: DataFrame, ks: Sequence[int], asked: dict, times: int) -> DataFrame:
        found = table.mapInArrow(_counter(seed, ks, asked, longest), schema)
        sums = found.groupBy(*_names(longest)).agg(F.sum("f").alias("f"), (F.min("check") != F.max("check")).alias("shared"))
        return staged(sums.filter((F.col("f") >= times) | F.col("shared")), "phrase-counts")

    def of_length(counts: DataFrame, k: int) -> DataFrame:
        rest = [F.col(f"w{i}") for i in range(k, min(k + 1, longest))]
        return counts.filter(reduce(lambda c, w: c & (w == 0), rest, F.col(f"w{k - 1}") != 0)).select(*_names(k), "f")

    part = staged(rows.filter(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(sample)) == 0), "phrase-sample")
    propose: dict[int, DataFrame] = {}
    asked: dict[int, Members] = {}
    for k in lengths[:-1]:
        propose[k] = of_length(counted(part, (k,), {j: (m, None) for j, m in asked.items()}, proposed), k)
        asked[k] = _members([propose[k]], k)
    counts = counted(rows, lengths, {k: (m, None) for k, m in asked.items()}, least)
    if not counts.filter("shared").isEmpty():  # two words of one hash: other hashes
        return mine(docs, least, longest, sample, proposed, seed + 1)
    passes = [lengths]
    frequent = {k: of_length(counts, k) for k in lengths}
    for k in lengths[1:]:
        failures = frequent[k - 1].join(propose[k - 1], _names(k - 1), "left_anti")
        if not failures.isEmpty():
            wider = _members([frequent[k - 1], propose[k - 1]], k - 1)
            more = counted(rows, (k,), {k - 1: (wider, asked[k - 1])}, least)
            frequent[k] = staged(frequent[k].unionByName(of_length(more, k)), "phrases-frequent")
            passes.append((k,))
            wider.close()
    for m in asked.values():
        m.close()
    return Counts(frequent, passes, seed)


def spelled(docs: DataFrame, words: DataFrame, seed: int) -> DataFrame:
    """(lang, g, w0, word, n) from one pass: the spelling of ``words(g, w0)``, and rows without w0 with the words of each language."""
    members = _members([words], 1)
    found = _texts(docs).mapInArrow(_speller(seed, members), "lang string, g bigint, w0 bigint, word string, n bigint")
    out = staged(found.groupBy("lang", "g", "w0", "word").agg(F.sum("n").alias("n")), "phrase-words")
    members.close()
    return out


def _exact(name: str) -> str:
    return f"cast({name} as decimal(14, 0))"


def _scored(phrases: DataFrame, k: int, frequent: dict[int, DataFrame]) -> DataFrame:
    """Phrases of k words (f as a) with the l, r and score of their lowest-scoring cut, of equal ones the first."""
    out = phrases.select(*_names(k), F.col("f").alias("a"))
    for j in range(1, k):
        left = frequent[j].select(*_names(j), F.col("f").alias(f"l{j}"))
        right = frequent[k - j].select("g", *(F.col(f"w{i}").alias(f"w{i + j}") for i in range(k - j)), F.col("f").alias(f"r{j}"))
        out = out.join(left, _names(j)).join(right, _names(k - j, j))
    score = "cast(1000000 as decimal(7, 0)) * {a} * {a} div ({l} * {r})"  # at most 37 digits
    cuts = [
        F.struct(F.expr(score.format(a=_exact("a"), l=_exact(f"l{j}"), r=_exact(f"r{j}"))).alias("score"), F.lit(j).alias("j"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r"))
        for j in range(1, k)
    ]
    lowest = F.array_min(F.array(*cuts))
    return out.withColumn("cut", lowest).select(*_names(k), "a", "cut.l", "cut.r", "cut.score")


def _not_contained(phrases: DataFrame, k: int, longer: DataFrame, percent: int) -> DataFrame:
    """Without phrases that a phrase one word longer contains in at least ``percent`` of their occurrences. A phrase still
    longer that often would make the one between it as frequent."""
    ends = [longer.select("g", *(F.col(f"w{i + j}").alias(f"w{i}") for i in range(k)), F.col("f").alias("_in")) for j in (0, 1)]
    most = ends[0].unionByName(ends[1]).groupBy(*_names(k)).agg(F.max("_in").alias("_in"))
    return phrases.join(most, _names(k), "left").filter(F.col("_in").isNull() | (100 * F.col("_in") < percent * F.col("a"))).drop("_in")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, contained: int = CONTAINED, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    counts = mine(docs, least, longest, **options)
    parts = []
    for k in range(2, longest + 1):
        rows = _scored(counts.frequent[k], k, counts.frequent)
        if k < longest:
            rows = _not_contained(rows, k, counts.frequent[k + 1], contained)
        parts.append(rows.select("g", F.array(*_names(k)[1:]).alias("words"), "a", "l", "r", "score"))
    best = [F.col("score").desc(), F.col("a").desc()]
    near = reduce(DataFrame.unionByName, parts).withColumn("_rank", F.rank().over(Window.partitionBy("g").orderBy(*best)))
    near = staged(near.filter(F.col("_rank") <= top).drop("_rank"), "phrases-ranked")
    used = near.select("g", F.explode("words").alias("w0")).distinct()
    words = spelled(docs, used, counts.seed)
    named = near.select("*", F.posexplode("words").alias("_at", "w0")).join(words.filter("w0 is not null").select("g", "w0", "word"), ["g", "w0"])
    named = named.groupBy("g", "words", "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("_at", "word"))).alias("_s"))
    rows = named.withColumn("phrase", F.array_join("_s.word", " "))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*best, "phrase")).cast("bigint"))
    return rows.filter(F.col("rank") <= top).join(words.filter("w0 is null").select("g", "lang", "n"), "g").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
