"""Best fuzzy match of trade names against the catalogue of a region, without comparing every pair.

A pair of different names can only be accepted when its similarity reaches ``0.80`` less the largest bonus. A ratio
``r`` needs ``r * (la + lb) / 2`` common characters (with multiplicity), so two names that reach it share one of their
rarest characters: both sides keep only a prefix of their characters in rarity order and meet by an equi-join there.
The bound loses no acceptable pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.functions.months import let
from hanok.functions.similarity import block_ratio
from hanok.functions.text import norm_name
from hanok.session import cut

POOL_THRESHOLD, REGION_THRESHOLD = 0.74, 0.80
CONTAINED = 0.92
LEAST_RATIO = 0.71 - 1e-9  # the region threshold less both bonuses (.05 and .04), a hair lower against rounding

#: Bonus by the gap of two known years; larger gaps; the same dong; dongs of which neither holds the other.
YEAR_BONUS = {gap: 0.05 if gap == 0 else 0.02 if abs(gap) <= 2 else 0.0 for gap in range(-6, 7)}
FAR_YEARS, SAME_DONG, OTHER_DONG = -0.12, 0.04, -0.04
ANY, UNKNOWN = "*", "-"  # marks; the mark of a value begins with "="


def _mark(value):
    return F.concat(F.lit("="), value.cast("string"))


def _offers(unknown, near, apart: float):
    """(mark, bonus) of a complex for every key that may ask for it: its values in ``near``, all keys, keys without a value."""

    def offer(mark, bonus):
        return F.struct(mark.alias("mark"), F.lit(bonus).alias("bonus"))

    rest = offer(F.lit(UNKNOWN), 0.0)
    known = F.array(*(offer(_mark(value), bonus) for value, bonus in near), offer(F.lit(ANY), apart), rest)
    return F.when(unknown, F.array(offer(F.lit(ANY), 0.0), rest)).otherwise(known)


def _asks(unknown, value):
    """Marks that a key asks for."""
    return F.when(unknown, F.array(F.lit(UNKNOWN))).otherwise(F.array(_mark(value), F.lit(ANY)))


def _year(c: str):
    """Whole year, 0 if unknown."""
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _dong(c: str):
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def _tokens(key: str):
    """Characters of a name in order, the i-th copy of a character being one of its own."""
    # sorted once per name, not once per character
    return let(
        F.array_sort(F.filter(F.split(key, ""), lambda c: c != "")),
        lambda s: F.transform(s, lambda c, i: F.concat(c, (i - F.array_position(s, c) + 1).cast("string"))),
    )


def _signed(names: DataFrame, key: str, rarity: DataFrame, least: float) -> DataFrame:
    """(region, name) with the prefix characters it has to share with any partner of ratio ``least`` or more."""
    rows = names.select("region", key, F.explode(_tokens(key)).alias("token")).join(rarity, "token", "left")
    packed = rows.groupBy("region", key).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("f"), F.col("token").alias("t")))).alias("ts")
    )
    # partner lengths lie within [la * r / (2 - r), ...]; the smallest partner needs the fewest common characters
    size = F.size("ts")
    smallest = F.ceil(size * (least / (2 - least)) - 1e-9)
    needed = F.greatest(F.lit(1), F.ceil((size + smallest) * (least / 2) - 1e-9))
    prefix = F.slice("ts", F.lit(1), (size - needed + 1).cast("int"))
    return packed.select("region", key, F.explode(F.transform(prefix, lambda x: x["t"])).alias("token"))


def similar_names(trade_names: DataFrame, catalogue_names: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """Pairs of different names of a region with their base score, all those that can still be accepted.

    Inputs hold distinct (region, trade_name) and (region, name).
    """
    rarity = catalogue_names.select(F.explode(_tokens("name")).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))
    a = _signed(trade_names, "trade_name", rarity, least)
    b = _signed(catalogue_names, "name", rarity, least)
    pairs = a.join(b, ["region", "token"]).select("region", "trade_name", "name").distinct()
    la, lb = F.length("trade_name"), F.length("name")
    pairs = pairs.filter((F.col("trade_name") != F.col("name")) & (2.0 * F.least(la, lb) >= least * (la + lb) - 1e-9))
    inside = F.contains("trade_name", F.col("name")) | F.contains("name", F.col("trade_name"))
    # pairs with too few characters in common are told within the ratio's own batch; the ratio is not symmetric
    scored = pairs.withColumn("inside", inside).withColumn("ratio", block_ratio("name", "trade_name", least))
    base = F.when(F.col("inside"), CONTAINED).otherwise(F.col("ratio"))
    return scored.withColumn("base", base).filter(F.col("base") >= least).select("region", "trade_name", "name", "base")


def contained_names(trade_names: DataFrame, catalogue_names: DataFrame) -> DataFrame:
    """Pairs where one name lies inside the other, however different their lengths.

    The shorter name's first two characters have to be one of the two-character runs of the longer one (one-character
    names meet on that character).
    """

    def runs(text, n):
        last = F.length(text) - n
        grams = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substr(text, i + 1, F.lit(n)))
        return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))

    def all_runs(df, key):
        both = F.array_distinct(F.concat(runs(F.col(key), 1), runs(F.col(key), 2)))
        return df.select("region", key, F.explode(both).alias("g"))

    def heads(df, key):
        return df.filter(F.length(key) > 0).select("region", key, F.substring(key, 1, 2).alias("g"))

    forward = heads(trade_names, "trade_name").join(all_runs(catalogue_names, "name"), ["region", "g"]).filter(F.contains("name", F.col("trade_name")))
    backward = all_runs(trade_names, "trade_name").join(heads(catalogue_names, "name"), ["region", "g"]).filter(F.contains("trade_name", F.col("name")))
    both = forward.select("region", "trade_name", "name").unionByName(backward.select("region", "trade_name", "name"))
    return both.filter(F.col("trade_name") != F.col("name")).distinct().withColumn("base", F.lit(CONTAINED))


def best_by_bonus(places: DataFrame, seen: DataFrame) -> DataFrame:
    """``choices`` of each (region, name, year, dong) of ``places``: the best complex at each pair of year and dong bonus.

    Complexes and places of one name do not meet in pairs: a complex stands for itself at the years and the dong near it and,
    at the least bonus, for any other. Where it is near it thus stands twice, but then its better bonus wins.
    """
    on = ["region", "name"]
    best = F.struct((-F.col("first.ord")).alias("o"), F.col("first.complex_id").alias("complex_id")).alias("best")
    c = seen.select(*on, _year("c_year").alias("year"), _dong("c_dong").alias("dong"), best)
    # as many tasks as the session shuffles into: few bytes here become many rows
    c = c.repartition(int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on, "dong")
    year, dong = F.col("year"), F.col("dong")

    offers = _offers(year == 0, [(year + gap, bonus) for gap, bonus in YEAR_BONUS.items()], FAR_YEARS)
    by_year = (
        c.select(*on, "dong", F.inline(offers).alias("year_mark", "year_bonus"), "best")
        .groupBy(*on, "dong", "year_mark", "year_bonus").agg(F.max("best").alias("best"))
    )
    dongs = c.select(*on, "dong").distinct()
    own = dongs.select(*on, "dong", F.inline(_offers(dong == "", [(dong, SAME_DONG)], OTHER_DONG)).alias("dong_mark", "dong_bonus"))
    # only distinct texts of a name are held against each other
    asked = F.col("asked")
    holds = (asked != "") & (dong != "") & (asked != dong) & (F.contains(asked, dong) | F.contains(dong, asked))
    within = places.select(*on, dong.alias("asked")).distinct().join(dongs, on).filter(holds)
    within = within.select(*on, "dong", _mark(asked).alias("dong_mark"), F.lit(0.0).alias("dong_bonus"))
    marks, bonuses = ["year_mark", "dong_mark"], ["year_bonus", "dong_bonus"]
    # years multiply rows unseen by estimates: without the hint the driver may be sent them all
    offered = by_year.hint("merge").join(own.unionByName(within), [*on, "dong"]).groupBy(*on, *marks, *bonuses).agg(F.max("best").alias("best"))

    wanted = places.withColumn("year_mark", F.explode(_asks(year == 0, year))).withColumn("dong_mark", F.explode(_asks(dong == "", dong)))
    return wanted.join(offered, [*on, *marks]).groupBy(*on, "year", "dong").agg(F.collect_list(F.struct(*bonuses, "best")).alias("choices"))


def best_match(keys: DataFrame, complexes: DataFrame) -> DataFrame:
    """Best complex per distinct key ``(region, raw_name, build_year, legal_dong)``; null below the threshold.

    ``complexes`` needs ``ord``, the catalogue order, which breaks ties. Where some name of the region is equal, only
    those complexes compete and the lower threshold applies; otherwise every complex of the region does. Years are whole.
    """
    # keys, catalogue and unmatched names are written once: every branch below starts from them
    k = cut(keys.withColumn("trade_name", norm_name("raw_name")))
    c = complexes.select("complex_id", "region", norm_name("name").alias("name"), F.col("build_year").alias("c_year"), F.col("legal_dong").alias("c_dong"), "ord")
    # complexes that look the same to the score compete as one: the first in catalogue order
    seen = cut(c.groupBy("region", "name", "c_year", "c_dong").agg(F.min(F.struct("ord", "complex_id")).alias("first")))

    trade_names = k.filter("trade_name <> ''").select("region", "trade_name").distinct()
    names = seen.filter("name <> ''").select("region", "name").distinct()
    equal = names.select("region", F.col("name").alias("trade_name")).join(trade_names, ["region", "trade_name"])
    rest = cut(trade_names.join(equal, ["region", "trade_name"], "left_anti"))
    near = similar_names(rest, names).unionByName(contained_names(rest, names))
    bases = near.groupBy("region", "trade_name", "name").agg(F.max("base").alias("base"))
    bases = bases.withColumn("least", F.lit(REGION_THRESHOLD)).unionByName(
        equal.select("region", "trade_name", F.col("trade_name").alias("name"), F.lit(1.0).alias("base"), F.lit(POOL_THRESHOLD).alias("least"))
    )

    bases = cut(bases)
    candidates = k.join(bases, ["region", "trade_name"]).withColumn("year", _year("build_year")).withColumn("dong", _dong("legal_dong"))
    at = ["region", "name", "year", "dong"]
    choices = best_by_bonus(candidates.select(*at).distinct(), seen)

    def scored(choice):
        score = F.col("base") + choice["year_bonus"] + choice["dong_bonus"]
        return F.struct(score.alias("score"), choice["best"]["o"].alias("o"), choice["best"]["complex_id"].alias("complex_id"))

    by = ["region", "raw_name", "build_year", "legal_dong"]
    # below the threshold a candidate cannot win, so only the others reach the aggregate
    good = candidates.join(choices, at).withColumn("m", F.array_max(F.transform("choices", scored))).filter(F.col("m.score") >= F.col("least"))
    best = good.groupBy(*by).agg(F.max("m").alias("m"))
    accepted = best.select(*by, F.col("m.complex_id").alias("complex_id"), F.col("m.score").alias("score"))
    return k.select(*by).join(accepted, by, "left")
