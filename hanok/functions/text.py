"""Name normalisation as column expressions, plus the two helpers that need Python (exact NFKC, sequence ratio)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hanok.functions import fixed_values as fv
from hanok.functions.months import col, let

KEPT = "0-9a-z가-힣"


# Characters that count as blank at the ends of a text.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2002\u2003\u2009\u3000"


def clean(c) -> Column:
    """Text without blanks at its ends; null becomes the empty text."""
    return F.coalesce(F.btrim(col(c).cast("string"), F.lit(BLANKS)), F.lit(""))


def first_nonblank(*cols) -> Column:
    """First column whose trimmed text is not empty, ``nan`` or ``None``; otherwise the empty text."""
    # each text is trimmed once; a CASE would mention it twice, in generated code as well
    texts = F.array(*[clean(c) for c in cols], F.lit(""))  # not without any, whose type would be unknown
    return F.coalesce(F.get(F.array_except(texts, F.array(F.lit(""), F.lit("nan"), F.lit("None"))), 0), F.lit(""))


@lru_cache(maxsize=1)
def compatibility_forms() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility form holds a kept character: one-to-one pairs and longer expansions."""
    kept = re.compile(f"[{KEPT}]")
    source, target, longer = [], [], {}
    for point in range(0x110000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        ch = chr(point)
        form = unicodedata.normalize("NFKC", ch)
        if form == ch or not kept.search(form.lower()):
            continue
        if len(form) == 1:
            source.append(ch)
            target.append(form)
        else:
            longer[ch] = form
    return "".join(source), "".join(target), longer


@lru_cache(maxsize=2)
def _suspects(expanding: bool = False) -> str:
    """Character class of the code ranges that hold such characters; a range may cover others too."""
    source, _, longer = compatibility_forms()
    points = sorted(ord(ch) for ch in ([*longer] if expanding else [*source, *longer]))
    ranges = [[points[0], points[0]]]
    for point in points[1:]:
        if point - ranges[-1][1] <= 64:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def compat(c) -> Column:
    """Compatibility normalisation without Python: a per-character mapping, only for texts that may need it.

    Equals NFKC on every kept character unless the text holds combining marks or separate jamo; use :func:`nfkc` for those.
    """
    source, target, longer = compatibility_forms()
    table = F.str_to_map(F.lit("\u0001".join(f"{a}\u0002{b}" for a, b in longer.items())), F.lit("\u0001"), F.lit("\u0002"))

    def mapped(s):
        single = F.translate(s, source, target)
        found = F.array_distinct(F.regexp_extract_all(s, F.lit(_suspects(expanding=True)), F.lit(0)))
        return F.aggregate(found, single, lambda acc, ch: F.replace(acc, ch, F.coalesce(F.element_at(table, ch), ch)))

    return F.when(col(c).rlike(_suspects()), mapped(col(c))).otherwise(col(c))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Exact NFKC; apply it to distinct names, not to every trade row."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


# Conjoining jamo and how syllables are numbered from them.
JAMO = "[\u1100-\u1112][\u1161-\u1175][\u11a8-\u11c2]?"
FIRST_SYLLABLE, LEADS, VOWELS, TAILS = 0xAC00, 0x1100, 0x1161, 0x11A7


def composed(c) -> Column:
    """Hangul syllables in place of their conjoining jamo; only texts that hold such jamo pay for it."""

    def syllable(jamo):
        def place(i, base):
            return F.ascii(F.substr(jamo, F.lit(i), F.lit(1))) - base

        tail = F.when(F.length(jamo) > 2, place(3, TAILS)).otherwise(0)
        code = (place(1, LEADS) * 21 + place(2, VOWELS)) * 28 + tail + FIRST_SYLLABLE
        return F.decode(F.unhex(F.hex(code)), "UTF-16BE")

    s = col(c)
    # the longest spellings first, so that a syllable without a tail does not eat the head of one with it
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit(JAMO), F.lit(0))), lambda a, b: F.length(b) - F.length(a))
    return F.when(s.rlike(JAMO), F.aggregate(found, s, lambda acc, jamo: F.replace(acc, jamo, syllable(jamo)))).otherwise(s)


# Outside ASCII and whole syllables, the only texts that hold jamo or compatibility forms.
UNCOMMON = r"[^\x00-\x7f가-힣]"


def folded(c) -> Column:
    """Composed and compatible text; one test of two ranges spares common texts the long character classes."""
    return let(col(c), lambda s: F.when(s.rlike(UNCOMMON), let(composed(s), compat)).otherwise(s))


def norm(c, exact: bool = False) -> Column:
    """Letters and digits of a name, lower case, without the word for apartment."""
    s = nfkc(col(c)) if exact else folded(c)
    s = F.replace(F.lower(F.coalesce(s, F.lit(""))), F.lit(fv.APARTMENT), F.lit(""))
    return F.regexp_replace(s, f"[^{KEPT}]+", "")


def norm_name(c) -> Column:
    """As :func:`norm` but bracketed parts and ``apt`` go too, unless nothing would be left."""

    def strip(s):
        return F.regexp_replace(s, f"{fv.APARTMENT}|apt|[^{KEPT}]", "")

    def both(raw):
        return F.coalesce(F.nullif(strip(F.regexp_replace(raw, r"\([^)]*\)", "")), F.lit("")), strip(raw))

    return let(F.lower(F.coalesce(folded(c), F.lit(""))), both)


def station_name(c) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\([^)]*\)|\s|역$", "")


def drop_prefix(s, prefix, at_least: int = 0) -> Column:
    s, p = col(s), col(prefix)
    hit = (F.length(p) >= at_least) & F.startswith(s, p)
    return F.when(hit, F.substr(s, F.length(p) + 1)).otherwise(s)


def drop_suffix(s, suffix: str) -> Column:
    return F.regexp_replace(col(s), f"{re.escape(suffix)}$", "")


def _brands(s) -> Column:
    return F.replace(F.replace(s, F.lit("에스케이"), F.lit("sk")), F.lit("엘지"), F.lit("lg"))


def canonical_name(name, region) -> Column:
    """Normalised name with unified brand spelling, without the leading city name."""
    return drop_prefix(_brands(norm(name)), norm(drop_suffix(region, "시")))


def name_key(name, region, dong) -> Column:
    """Spelling-independent key ``letters|n1,n2``: place prefix, village word and phase words do not count."""
    s = _brands(F.replace(norm(name), F.lit("e편한"), F.lit("이편한")))
    s = drop_prefix(s, norm(drop_suffix(region, "시")), 2)
    s = drop_prefix(s, drop_suffix(norm(F.coalesce(col(dong), F.lit(""))), "동"), 2)
    s = F.replace(F.replace(s, F.lit(fv.APARTMENT), F.lit("")), F.lit("마을"), F.lit(""))
    s = F.regexp_replace(s, "([0-9]+)(?:단지|차)", "$1")
    numbers = F.array_join(F.regexp_extract_all(s, F.lit("([0-9]+)"), F.lit(1)), ",")
    return F.concat(F.regexp_replace(s, "[0-9]+", ""), F.lit("|"), numbers)


def folded_header(text: str) -> str:
    """Header text without blanks, hyphens, brackets and slashes, lower case (driver side, headers only)."""
    return re.sub(r"[\s_\-()/]+", "", text.strip()).lower()
