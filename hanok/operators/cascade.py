"""Portal rows: two contracts per row, and the four-step link to a complex."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hanok.functions import fixed_values as fv
from hanok.functions.months import once, ym_of_date
from hanok.functions.parcels import pnu_identity
from hanok.functions.text import canonical_name, clean, name_key, norm
from hanok.functions.values import date_of_parts, date_parts, number
from hanok.operators import guards
from hanok.session import cut

GRAM = 4  # a contained name counts from this length on
SITE = ["region", "dong", "land_kind", "parcel", "build_year"]
KEY = [*SITE, "trade_name"]
REQUEST = ["code", "dong_code"]
FOUND = ["complex_id", "method"]


def effective_dong(disclosed, eup_scope, eup_name, canonical_dong) -> Column:
    """Legal dong of a row: within an eup the disclosed ``리`` decides, not the query; null when none is disclosed."""
    ri = F.regexp_replace(clean(disclosed), r"^[()（） ]+|[()（） ]+$", "")
    full = F.when(F.startswith(ri, F.col(eup_name)), ri).otherwise(F.concat_ws(" ", F.col(eup_name), ri))
    return F.when(~F.col(eup_scope), F.col(canonical_dong)).when(ri.endswith("리"), full)


def _not_whole(c) -> Column:
    n = number(c)
    return F.coalesce(n != F.floor(n), F.lit(True))


RAW_SITE = ["region", "canonical_dong", "eup_scope", "eup_name", "UMD_NM", "PNU", "MVIN_YM", "KAB_APTNM"]
PARSED = ["region", "eup_scope", "legal_dong", "dong", "i", "building", "trade_name"]


@dataclass(frozen=True)
class Sites:
    """Parsed identities, one row per distinct spelling and request, and the seed that keeps their marks apart."""

    parsed: DataFrame
    seed: int


def _mark(seed: int) -> Column:
    """64 bits of a row's spelling and request; an absent value differs from every other."""
    return F.xxhash64(F.lit(seed), *RAW_SITE, *REQUEST, *[F.col(c).isNull() for c in REQUEST])


def _spelled(rows: DataFrame) -> DataFrame:
    blank = [c for c in RAW_SITE if c != "eup_scope"]
    texts = rows.drop("dong").withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in blank})
    return texts.filter("eup_scope is not null")


def sites_of(rows: DataFrame) -> Sites:
    """Identities of portal rows: parcel id, legal dong and normalised name.

    Parsed once per distinct spelling, so the number of buildings decides the cost. The rows find theirs by a mark of 64 bits;
    another seed is taken where two spellings share a mark.
    """
    texts = _spelled(rows)
    for seed in range(16):
        spellings = texts.select(_mark(seed).alias("site"), *REQUEST, *RAW_SITE).distinct()
        parsed = cut(
            spellings.withColumn("legal_dong", effective_dong("UMD_NM", "eup_scope", "eup_name", "canonical_dong")).select(
                "site", *REQUEST, "region", "eup_scope", "legal_dong", norm(F.coalesce("legal_dong", F.lit(""))).alias("dong"),
                pnu_identity("PNU", "MVIN_YM").alias("i"), F.trim("KAB_APTNM").alias("building"), norm("KAB_APTNM").alias("trade_name"),
            )
        )
        if parsed.groupBy("site").count().filter("count > 1").isEmpty():
            return Sites(parsed, seed)
    raise RuntimeError("no seed keeps the marks of the spellings apart")


def _keyed(sites: Sites) -> DataFrame:
    return sites.parsed.withColumns({"land_kind": F.col("i.kind"), "parcel": F.col("i.parcel"), "build_year": F.col("i.year")})


def bound(sites: Sites, complexes: DataFrame, plan: DataFrame | None = None) -> Sites:
    """The sites with their complex and method (see :func:`resolve`), so that the rows find identity and complex at once."""
    key = KEY if plan is None else [*REQUEST, *KEY]
    keyed = _keyed(sites)
    found = keyed.select("site", *key).join(resolve(keyed.select(*key).distinct(), complexes, plan), key).select("site", *FOUND)
    return Sites(sites.parsed.join(found, "site", "left"), sites.seed)


def identified(rows: DataFrame, sites: Sites | None = None) -> DataFrame:
    """Rows with their parsed identity in place of the raw one; also with what their sites are bound to."""
    sites = sites or sites_of(rows)
    marked = _spelled(rows).withColumn("site", _mark(sites.seed)).drop(*RAW_SITE)
    return marked.join(sites.parsed.drop(*REQUEST), "site").drop("site")


def contracts(rows: DataFrame, sites: Sites | None = None) -> DataFrame:
    """One record per contract: column group A is the sale, B the deposit lease; group C (monthly rent) is not read.

    ``rows`` carries the request (``code, dong_code, year, region, dong, canonical_dong, eup_scope, eup_name``).
    ``excluded`` holds the first reason for which a row does not count. Of :func:`bound` sites, the contracts carry
    ``complex_id`` and ``method``.
    """
    with_id = identified(rows, sites)
    linked = [c for c in FOUND if c in with_id.columns]
    cancelled = clean("DPOS_GBN") != ""
    two = with_id.select(
        "code", "dong_code", "year", *PARSED, *linked,
        clean("BLDG_MUSE_CD").alias("use"), "BLDG_AREA", cancelled.alias("_cancelled"),
        F.expr("stack(2, 'sale', A11, A21, A31, 'lease', B11, B21, B31) as (side, _date, _price, _floor)"),
    ).filter((clean("_date") != "") & (clean("_price") != ""))
    # parsed once a row, as columns of their own: the months are filtered on, and inside a lambda nothing is compiled
    two = once(two, date_parts("_date").alias("_parts"), keep=[c for c in two.columns if c != "_date"])
    two = once(two, date_of_parts(F.col("_parts"), "year").alias("date"), keep=[c for c in two.columns if c != "_parts"])
    excluded = (
        F.when(F.col("i").isNull(), "unidentified")
        .when(F.col("legal_dong").isNull(), "unconfirmed_ri")
        .when(~F.col("use").isin("", "02001"), "other_use")
    )
    return two.select(
        "code", "dong_code", "year", "region", "eup_scope", "legal_dong", "building", "trade_name", "side",
        F.col("i.district").alias("id_district"), F.col("i.dong").alias("id_dong"),
        "dong", F.col("i.kind").alias("land_kind"),
        F.col("i.parcel").alias("parcel"), F.col("i.year").alias("build_year"),
        "date", ym_of_date("date").alias("ym"), number("BLDG_AREA").alias("area"),
        number("_floor").cast("int").alias("floor"), number("_price").cast("bigint").alias("price"),
        (_not_whole("_price") | ((clean("_floor") != "") & _not_whole("_floor"))).alias("bad_number"),
        ((F.col("side") == "sale") & F.col("_cancelled")).alias("cancelled"), excluded.alias("excluded"), *linked,
    )


def _only(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """Complex per key where all matches are one complex."""
    both = df.groupBy(*key).agg(F.min("complex_id").alias(name), F.max("complex_id").alias("_max"))
    return both.filter(F.col(name) == F.col("_max")).drop("_max")


def catalogue_names(complexes: DataFrame) -> DataFrame:
    """One row per (complex, alias), with every spelling the steps compare."""
    c = complexes.select(
        "complex_id", "region", norm("legal_dong").alias("dong"), "build_year", "metadata_parcels",
        F.explode(F.array_distinct("aliases")).alias("alias"),
    )
    return c.select(
        "*", norm("alias").alias("n"), name_key("alias", "region", "dong").alias("k"), canonical_name("alias", "region").alias("c")
    )


def resolve(keys: DataFrame, complexes: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """Match distinct keys in four steps, each by an equi-join, each only where exactly one complex fits.

    1 same parcel and year, equal name; 2 same parcel and year, one name inside the other (from four letters on);
    3 same parcel and year, equal up to place prefix, village and phase words; 4 same dong and year, equal canonical
    name of six letters or more, where one of the two sources has no parcel. Step 2 joins on the first four letters of
    the shorter name against the four-letter runs of the longer, so unrelated names of one parcel never meet.
    With ``plan(code, dong_code, complex_id)`` a key also holds the request that returned it, and only the complexes of
    that request are candidates: two districts of one city may have a dong of the same name.
    """
    names = catalogue_names(complexes)
    request = [] if plan is None else REQUEST
    if plan is not None:
        names = names.join(plan.select(*REQUEST, "complex_id").distinct(), "complex_id")
    site, key = [*request, *SITE], [*request, *KEY]
    names = cut(names)
    # names and probe are written once: every step below starts from them
    lots = names.select("complex_id", *request, "region", "dong", "build_year", F.explode("metadata_parcels").alias("p"), "n", "k")
    lots = lots.select("*", F.col("p.kind").alias("land_kind"), F.col("p.parcel").alias("parcel")).drop("p")
    probe = cut(keys.select(*key).filter("parcel is not null").distinct())

    exact = _only(probe.join(lots.withColumnRenamed("n", "trade_name"), key), key, "exact_id")

    def runs(text):
        last = F.greatest(F.length(text) - GRAM, F.lit(0))
        return F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i + 1, F.lit(GRAM)))))

    long_names = lots.filter(F.length("n") >= GRAM).select("complex_id", *site, "n")
    long_probe = probe.filter(F.length("trade_name") >= GRAM)
    inside_alias = long_probe.withColumn("_g", F.substring("trade_name", 1, GRAM)).join(
        long_names.withColumn("_g", runs(F.col("n"))), [*site, "_g"]
    ).filter(F.contains("n", F.col("trade_name")))
    inside_trade = long_probe.withColumn("_g", runs(F.col("trade_name"))).join(
        long_names.withColumn("_g", F.substring("n", 1, GRAM)), [*site, "_g"]
    ).filter(F.contains("trade_name", F.col("n")))
    picked = [*key, "complex_id"]
    contained = _only(inside_alias.select(*picked).unionByName(inside_trade.select(*picked)), key, "contained_id")

    keyed = probe.withColumn("k", name_key("trade_name", "region", "dong"))
    equivalent = _only(keyed.join(lots.select("complex_id", *site, "k"), [*site, "k"]), key, "equivalent_id")

    canon = probe.withColumn("c", canonical_name("trade_name", "region")).filter(F.length("trade_name") >= 6)
    whole = names.select("complex_id", *request, "region", "dong", "build_year", "c", (F.size("metadata_parcels") == 0).alias("_bare"))
    fallback = canon.join(whole, [*request, "region", "dong", "build_year", "c"]).filter((F.col("parcel") == "0") | F.col("_bare"))
    missing = _only(fallback, key, "fallback_id")

    out = probe
    for step in (exact, contained, equivalent, missing):
        out = out.join(step, key, "left")
    first = F.coalesce("exact_id", "contained_id")
    method = (
        F.when(first.isNotNull(), "parcel_name_year")
        .when(F.col("equivalent_id").isNotNull(), "parcel_normalized_name_year")
        .when(F.col("fallback_id").isNotNull(), "exact_name_dong_year_missing_parcel")
    )
    return cut(out.select(*key, F.coalesce(first, "equivalent_id", "fallback_id").alias("complex_id"), method.alias("method")))


def linked_contracts(contract_rows: DataFrame, complexes: DataFrame, start: str, end: str, plan: DataFrame | None = None) -> DataFrame:
    """Contracts of the period with their complex and ``outcome``. A cancelled sale leaves the lease of its row alone.

    Contracts of :func:`bound` sites have their complex already: then neither ``complexes`` nor ``plan`` is read again.
    """
    found = contract_rows.filter(F.col("excluded").isNull() & F.col("ym").between(start, end))
    if not set(FOUND) <= set(contract_rows.columns):
        # keys are taken from all rows: that pass reads the key columns only
        key = KEY if plan is None else [*REQUEST, *KEY]
        found = found.join(resolve(contract_rows.select(*key).distinct(), complexes, plan), key, "left")
    outcome = (
        F.when(F.col("complex_id").isNull(), "unmatched")
        .when(F.col("cancelled"), "cancelled_sale")
        .when((F.col("side") == "sale") & F.col("floor").isNull(), "missing_sale_floor")
        .otherwise("saved")
    )
    return found.withColumn("outcome", outcome)


SIGNATURE = ["complex_id", "side", "date", "area", "floor", "price", "parcel"]


def distinct_contracts(linked: DataFrame) -> DataFrame:
    """Saved contracts, equal disclosed rows once. The parcel tells sales apart, not leases."""
    lot = F.when(F.col("side") == "sale", F.col("parcel")).otherwise("")
    saved = linked.filter("outcome = 'saved'").withColumn("parcel", lot).withColumn("kind", F.lit(fv.KIND_UNKNOWN))
    return saved.dropDuplicates(SIGNATURE).select(*SIGNATURE, "ym", "legal_dong", "kind")


def reason_counts(contract_rows: DataFrame, linked: DataFrame) -> DataFrame:
    """Contracts per side and reason: left out before linking, lost in linking, repeated disclosures, and saved ones."""
    before = contract_rows.filter(F.col("excluded").isNotNull()).groupBy("side", F.col("excluded").alias("reason")).agg(F.count("*").alias("rows"))
    after = linked.filter("outcome <> 'saved'").groupBy("side", F.col("outcome").alias("reason")).agg(F.count("*").alias("rows"))
    lot = F.when(F.col("side") == "sale", F.col("parcel")).otherwise("")
    same = linked.filter("outcome = 'saved'").withColumn("parcel", lot).groupBy(*SIGNATURE).agg((F.count("*") - 1).alias("again"))
    kept = same.groupBy("side").agg(F.count("*").alias("saved"), F.sum("again").alias("duplicate_disclosed"))
    return before.unionByName(after).unionByName(kept.unpivot(["side"], ["saved", "duplicate_disclosed"], "reason", "rows").filter("rows > 0"))


def contract_guards(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """Responses that do not answer their request, unreadable dates, and bad numbers on linked contracts."""
    identified = rows.filter(F.coalesce(F.col("excluded") != "unidentified", F.lit(True)))
    counted = rows.filter("excluded is null")
    active = linked.filter(F.col("complex_id").isNotNull() & (F.col("outcome") != "cancelled_sale"))
    bad = F.col("bad_number") | guards.number_out_of_range("price", floor_required=False)
    return guards.all_of(
        guards.response_mismatch(identified),
        guards.violations(counted, "bad_contract_date", F.col("date").isNull(), F.concat_ws("/", "code", "dong_code", "year")),
        guards.violations(active, "invalid_contract", bad, "complex_id", F.concat_ws("/", "date", "area", "floor", "price")),
    )


def binding_methods(linked: DataFrame) -> DataFrame:
    """The steps by which each complex got its trades (at most three values per complex)."""
    seen = linked.filter("complex_id is not null").select("complex_id", "method").distinct()
    return seen.groupBy("complex_id").agg(F.array_sort(F.collect_set("method")).alias("trade_binding_methods"))
