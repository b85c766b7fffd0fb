"""Three-way merge of nested documents, level by level.

Of each place in a document the base, the local and the remote value are compared whole. The unchanged side yields; where both
changed, objects are merged key by key and lists of items with ids item by item, and everything else keeps the local value (none,
if it was deleted). Merged lists are ordered by ``savedAt``, else ``createdAt``; a list that holds presets keeps the newest ten.

Going down, a round decides all places of one level of all documents, and opens those that have to be merged; their children are
grouped by place and name, so a level is one shuffle. Going up, the children's results are joined to their place again. Rounds
are as many as the documents are deep. Documents are JSON text, parsed to variants; the order of an object's keys and white space
play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanok.session import cut

PRESETS = 10
_SIDES = ("remote", "local", "base")  # the order in which ids count
_FALSE = ("null", "false", "0", '""')


def canonical(text: Column) -> Column:
    """JSON with keys in order; null stays null, and is not the JSON value ``null``."""
    return F.to_json(F.parse_json(text))


def _is(text: Column, opening: str) -> Column:
    return F.coalesce(F.startswith(text, F.lit(opening)), F.lit(False))


def _field(item: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(item, f"$.{name}", kind)


def _truth(item: Column, name: str) -> Column:
    """Whether a field holds something: not absent, null, false, zero or empty."""
    return ~F.coalesce(F.to_json(_field(item, name)), F.lit("null")).isin(*_FALSE)


def _items(text: Column) -> Column:
    """The items of a list, none for anything else."""
    return F.when(_is(text, "["), F.parse_json(text).cast("array<variant>")).otherwise(F.array().cast("array<variant>"))


def _named(item: Column) -> Column:
    return _is(F.to_json(item), "{") & _truth(item, "id")


def decide(rows: DataFrame) -> DataFrame:
    """``rows(base, local, remote)`` with ``result`` or, where the children decide, ``open``: object or list."""
    b, left, r = (F.col(c) for c in ("base", "local", "remote"))
    lists = _is(left, "[") & _is(r, "[") & F.forall(_items(left), _named) & F.forall(_items(r), _named)
    objects = _is(left, "{") & _is(r, "{")
    kind = F.when(~b.eqNullSafe(left) & ~b.eqNullSafe(r), F.when(lists, "list").when(objects, "object"))
    with_kind = rows.withColumn("open", kind).withColumn("presets", F.col("open").eqNullSafe("list") & F.exists(_items(left), lambda x: _truth(x, "preset")))
    result = F.when(b.eqNullSafe(left), r).when(b.eqNullSafe(r) | F.col("open").isNull(), left)
    return with_kind.withColumn("result", result)


def children(places: DataFrame, key: Sequence[str]) -> DataFrame:
    """The places one level below open ones: (key, parent, name, at, base, local, remote)."""
    sides = []
    for order, side in enumerate(_SIDES):
        value = F.col(side)
        of_object = F.transform(
            F.map_entries(F.when(_is(value, "{"), F.parse_json(value).cast("map<string,variant>"))),
            lambda e: F.struct(F.to_json(F.array(e["key"])).alias("name"), F.to_json(e["value"]).alias("v")),
        )
        items = F.filter(_items(value), _named)
        of_list = F.transform(items, lambda x: F.struct(F.to_json(_field(x, "id")).alias("name"), F.to_json(x).alias("v")))
        found = F.when(F.col("open") == "list", of_list).otherwise(of_object)
        part = places.select(*key, F.col("place").alias("parent"), F.posexplode(found).alias("at", "c"))
        sides.append(part.select(*key, "parent", "c.name", "c.v", F.lit(side).alias("side"), (F.col("at") + F.lit(order) * F.lit(1 << 40)).alias("at")))
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2])
    held = [F.max_by("v", F.when(F.col("side") == s, F.col("at"))).alias(s) for s in _SIDES]  # of an id twice the last
    return rows.groupBy(*key, "parent", "name").agg(F.min("at").alias("at"), *held).withColumn("place", F.concat("parent", F.lit("/"), "name"))


def assembled(places: DataFrame, below: DataFrame, key: Sequence[str]) -> DataFrame:
    """Open places with the ``result`` that their children make."""
    kept = below.filter("result is not null").withColumn("_v", F.parse_json("result"))
    number = [F.nullif(_field(F.col("_v"), n, "double"), F.lit(0.0)) for n in ("savedAt", "createdAt")]
    item = F.struct(F.coalesce(*number, F.lit(0.0)).alias("time"), "at", "name", "result")
    lists = kept.groupBy(*key, F.col("parent").alias("place")).agg(F.array_sort(F.collect_list(item)).alias("c"))
    joined = places.drop("result").join(lists, [*key, "place"], "left").withColumn("c", F.coalesce("c", F.array().cast(lists.schema["c"].dataType)))
    last = F.when(F.col("presets"), F.slice("c", F.greatest(F.lit(1), F.size("c") - PRESETS + 1), F.lit(PRESETS))).otherwise(F.col("c"))
    as_list = F.concat(F.lit("["), F.array_join(F.transform(last, lambda x: x["result"]), ","), F.lit("]"))
    by_name = F.array_sort(F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["result"].alias("result"))))
    pairs = F.transform(by_name, lambda x: F.concat(F.substr(x["name"], F.lit(2), F.length(x["name"]) - 2), F.lit(":"), x["result"]))
    as_object = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    return joined.withColumn("result", F.when(F.col("open") == "list", as_list).otherwise(as_object)).drop("c")


def merge_documents(base: DataFrame, local: DataFrame, remote: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """``(key, value)``: the merged documents of three tables with one JSON text per key; a document deleted on one side and
    unchanged on the other has no row. Null texts count as absent."""
    rows = None
    for side, df in (("base", base), ("local", local), ("remote", remote)):
        part = df.select(*key, *(canonical(F.col(value)).alias(s) if s == side else F.lit(None).cast("string").alias(s) for s in _SIDES))
        rows = part if rows is None else rows.unionByName(part)
    top = rows.groupBy(*key).agg(*(F.max(s).alias(s) for s in _SIDES))
    level = top.select(*key, F.lit(None).cast("string").alias("parent"), F.lit("").alias("name"), F.lit(0).cast("bigint").alias("at"), *_SIDES, F.lit("").alias("place"))
    levels = []
    while True:
        decided = cut(decide(level))
        levels.append(decided.drop(*_SIDES))
        places = decided.filter("open is not null")
        if places.isEmpty():
            break
        level = children(places, key)
    below = levels.pop()
    while levels:
        here = levels.pop()
        done = here.filter("open is null")
        below = cut(done.unionByName(assembled(here.filter("open is not null"), below, key).select(*done.columns)))
    return below.filter("result is not null").select(*key, F.col("result").alias(value))
