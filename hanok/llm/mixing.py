"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash. Per source, words are summed by hash bucket; the running sum tells the bucket in
which the budget ends; only that boundary bucket is split again by the next bits, until it holds one hash. The mix is then
a plain filter ``hash < threshold``: no document is sorted and nothing but histograms is shuffled. What the first
threshold leaves open (its boundary document did not fit) goes to a second, nested budget among the documents left that
still fit, and so on for ``ROUNDS`` thresholds, so that a source ends within its smallest fitting document of the target.

A source whose target exceeds its size is taken whole, and the budget beyond is a second copy of some documents.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, ranked last;
documents with equal ids share a hash and are taken together or not at all (a null id hashes as the empty text). Extra
columns play no part. An empty table, or one without words, gives targets of 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hanok.llm.tables import WORD, staged
from hanok.operators.ranking import number_rows
from hanok.session import cut

HASH_BITS, LEVEL_BITS, ROUNDS = 60, 12, 5
TOP = 1 << HASH_BITS
WEIGHTS, EPOCHS, CAP = (5, 2, 1), 1.5, 2
#: Keys of one source, and sources up to which the plan is broadcast.
SALTS, MOST_SOURCES = 64, 100_000


def position(doc_id):
    """The document's place in [0, 2^60), the same in every run: 15 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, source, size, h) and ``more`` columns: words are counted in the whole text."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"), position(F.col("doc_id")).alias("h"), *more)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, cap: float = CAP) -> DataFrame:
    """(source, rank, source_size, target): ``epochs`` times all words shared by weight, no target above ``cap`` sources.

    Resharing the excess until no target is above its cap is a water level: target = min(cap * size, level * weight).
    Each round aggregates three numbers over the sources; the level only rises.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(totals, F.col("source").isNull().asc(), F.col("source").asc())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    ranked = cut(ranked.withColumn("weight", F.element_at(kinds, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))))
    most = F.lit(float(cap)) * F.col("source_size")
    level = 0.0
    while True:
        full = most <= F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, most).otherwise(0.0)).alias("capped"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["all"] or not row["open"]:
            break
        higher = (epochs * row["all"] - row["capped"]) / row["open"]
        if higher <= level:
            break
        level = higher
    return ranked.select("source", "rank", "source_size", F.least(most, F.lit(level) * F.col("weight")).alias("target"))


def _meet(rows: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    """``rows`` with their source's ``state``. ``few`` sources are broadcast; of more, each is spread over ``SALTS`` keys, so
    that a large one is many tasks' work."""
    if few:
        return rows.join(F.broadcast(state), "rank")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return rows.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(state.select("*", salts), ["rank", "salt"]).drop("salt")


def _threshold(rows: DataFrame, budgets: DataFrame, few: bool) -> DataFrame:
    """(rank, below): per source the largest hash bound such that the sizes of ``rows(rank, h, size)`` under it fit ``budget``.

    ``low`` is the first hash of the bucket still open, ``used`` the sum below it.
    """
    state = budgets.select("rank", "budget", F.lit(0).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("used"))
    left = HASH_BITS
    closed = None
    while left > 0:
        width = min(LEVEL_BITS, left)
        left -= width
        inside = _meet(rows, state, few).filter((F.col("h") >= F.col("low")) & (F.col("h") - F.col("low") < F.lit(1 << (left + width))))
        bucket = F.shiftright(F.col("h") - F.col("low"), left)
        sums = inside.groupBy("rank", "budget", "low", "used", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("first"), F.max("h").alias("last")
        )
        so_far = Window.partitionBy("rank").orderBy("bucket")  # at most 4,096 buckets a source
        upto = F.col("used") + F.sum("words").over(so_far)
        over = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("budget"))
        bound = over.groupBy("rank", "budget").agg(F.min(F.struct("bucket", "low", "first", "last", F.expr("upto - words").alias("before"))).alias("b"))
        bound = cut(
            bound.select(
                "rank", "budget",
                (F.col("b.low") + F.shiftleft("b.bucket", left)).alias("low"),
                F.col("b.before").alias("used"),
                F.col("b.first").alias("first"),
                (F.col("b.first") == F.col("b.last")).alias("single"),
            )
        )
        done = bound.filter("single").select("rank", F.col("first").alias("below"))
        closed = done if closed is None else closed.unionByName(done)
        state = bound.filter("not single").select("rank", "budget", "low", "used")
        if state.isEmpty():
            break
    # a source that is never over its budget takes all that is left
    return budgets.select("rank").join(closed, "rank", "left").select("rank", F.coalesce("below", F.lit(TOP)).alias("below"))


@dataclass(frozen=True)
class Plan:
    """One row per source (source, source_size, target, whole, and per round the largest size that fits and the bound of
    the hashes taken), and what a document's copies are in terms of it."""

    rows: DataFrame
    copies: Column
    few: bool  # counted: at most MOST_SOURCES rows

    def join(self, docs: DataFrame) -> DataFrame:
        """``docs`` (with source, size, h) and the columns of their source, broadcast or spread over salts as in ``_meet``."""
        plan = self.rows.withColumnRenamed("source", "_mx_source")
        same = docs["source"].eqNullSafe(F.col("_mx_source"))
        if self.few:
            return docs.join(F.broadcast(plan), same).drop("_mx_source")
        salted = plan.withColumn("_mx_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return docs.join(salted, same & (F.pmod(docs["h"], F.lit(SALTS)) == F.col("_mx_salt"))).drop("_mx_source", "_mx_salt")


def plan(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, epochs: float = EPOCHS, cap: float = CAP, rounds: int = ROUNDS) -> Plan:
    """The plan for ``sizes(source, size, h)``, which should be staged: every round reads it."""
    goal = targets(sizes, weights, epochs, cap)
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    goal = cut(goal.withColumn("whole", whole.cast("bigint")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    few = goal.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    rows = staged(Plan(goal.select("source", "rank"), F.lit(0), few).join(sizes).filter("size > 0").select("rank", "h", "size"), "ranked")
    chosen = F.lit(False)
    budgets = goal.select("rank", "budget")
    limits = budgets.select("rank")
    for k in range(rounds):
        limits = limits.join(budgets.select("rank", F.col("budget").alias(f"fit{k}")), "rank")
        fits = _meet(rows, limits, few).filter(~chosen & (F.col("size") <= F.col(f"fit{k}"))).select("rank", "h", "size")
        if k and fits.isEmpty():
            limits = limits.drop(f"fit{k}")
            break
        below = _threshold(fits, budgets, few)
        limits = cut(limits.join(below.withColumnRenamed("below", f"below{k}"), "rank"))
        now = (F.col("size") <= F.col(f"fit{k}")) & (F.col("h") < F.col(f"below{k}"))
        spent = _meet(fits, limits, few).filter(now).groupBy("rank").agg(F.sum("size").alias("spent"))
        budgets = cut(budgets.join(spent, "rank", "left").select("rank", (F.col("budget") - F.coalesce("spent", F.lit(0))).alias("budget")))
        chosen = chosen | now
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(chosen, 1).otherwise(0)).otherwise(0).cast("bigint")
    return Plan(cut(goal.join(limits, "rank").drop("rank", "budget")), copies, few)


def mix(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies), one row per row of ``docs(doc_id, source, text)``."""
    sizes = staged(sized(docs), "sizes")
    found = plan(sizes, **how)
    rows = found.join(sizes).withColumn("copies", found.copies)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns, ``taken`` words and ``copies`` (replacing columns of
    these names): a document is to be read ``copies`` times."""
    found = plan(staged(sized(docs), "sizes"), **how)
    whole = docs.select(F.struct(*docs.columns).alias("_mx_row"), *[F.col(c) for c in ("doc_id", "source", "text")])
    rows = found.join(sized(whole, "_mx_row")).withColumn("copies", found.copies).filter("copies > 0")
    kept = [F.col(f"_mx_row.`{c}`").alias(c) for c in docs.columns if c not in ("taken", "copies")]
    return rows.select(*kept, (F.col("copies") * F.col("size")).alias("taken"), "copies")
