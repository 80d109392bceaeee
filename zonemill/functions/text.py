"""Text rules: normal forms, address keys, labels, natural order of house numbers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_form(text: str | None) -> str | None:
    """NFKC, trimmed, runs of Unicode white space as one blank, case folded. Null stays null."""
    return None if text is None else " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


@F.pandas_udf(T.StringType())
def _normal_form(text: pd.Series) -> pd.Series:
    known: dict = {}
    return text.map(lambda t: known[t] if t in known else known.setdefault(t, normal_form(t)))


#: Code points whose normal form is their lower case: printable ASCII, and basic Cyrillic. Everything else goes through Python.
_PLAIN = r"^[\x09-\x0D\x20-\x7EА-яЁё]*$"


def normalize_text(text: Column) -> Column:
    """normal_form(), in exact Python. For plain alphabets use normalize_plain(), which stays in the JVM."""
    return _normal_form(text)


def is_plain(text: Column) -> Column:
    """Whether normalize_plain() is exact for a text."""
    return F.coalesce(text.rlike(_PLAIN), F.lit(True))


def normalize_plain(text: Column) -> Column:
    """normal_form() of texts for which is_plain() holds."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " ")))


def normalize(text: Column) -> Column:
    """normal_form(): in the JVM where that is exact, else in Python, which gets no other texts."""
    return F.coalesce(F.when(is_plain(text), normalize_plain(text)), _normal_form(F.when(~is_plain(text), text)))


def blank_to_null(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != "", trimmed)


def address_key(street: Column, number: Column, norm=normalize) -> Column:
    """Pair of normal forms; null counts as ''."""
    return F.struct(norm(F.coalesce(street, F.lit(""))).alias("street"), norm(F.coalesce(number, F.lit(""))).alias("number"))


def canonical_key(settlement: Column, street: Column, number: Column, district: Column | None = None, district_needed: Column | None = None, norm=normalize) -> Column:
    """settlement|district|street|number in normal form; null unless settlement, street and number are all there. The
    district takes part only where needed, and is empty otherwise. No zone is ever part of it."""
    s, t, n = (norm(F.coalesce(x, F.lit(""))) for x in (settlement, street, number))
    d = F.lit("")
    if district is not None:
        needed = F.lit(True) if district_needed is None else district_needed
        d = F.when(needed, norm(F.coalesce(district, F.lit("")))).otherwise("")
    return F.when((s != "") & (t != "") & (n != ""), F.concat_ws("|", s, d, t, n))


def canonical_key_short(settlement: Column, street: Column, number: Column, norm=normalize) -> Column:
    """The older form without a place for the district: settlement|street|number."""
    s, t, n = (norm(F.coalesce(x, F.lit(""))) for x in (settlement, street, number))
    return F.when((s != "") & (t != "") & (n != ""), F.concat_ws("|", s, t, n))


def display_address(street: Column, qualifier: Column) -> Column:
    """street, or street (qualifier); '' without a street."""
    name = F.coalesce(F.trim(street), F.lit(""))
    return F.when(name == "", "").when(F.coalesce(qualifier, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(" ("), qualifier, F.lit(")")))


def full_address(settlement: Column, district: Column, street: Column, number: Column, house_word: str = "дом") -> Column:
    """settlement, district, street, house word and number; blank parts are left out."""
    head = F.concat_ws(", ", *[F.when(x != "", x) for x in (settlement, district, F.trim(street))])
    return F.when(F.coalesce(F.trim(number), F.lit("")) != "", F.concat(head, F.lit(f", {house_word} "), F.trim(number))).otherwise(head)


def address_status(street: Column, number: Column) -> Column:
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return F.when(has(number) & has(street), "verified_osm_address").when(has(number), "osm_housenumber_without_street").otherwise("unaddressed_delivery_unit")


def house_number_order(number: Column) -> Column:
    """Sort key (number, text): 2 before 2A before 10; without digits last."""
    text = F.trim(F.coalesce(number, F.lit("")))
    digits = F.regexp_extract(text, r"([0-9]+)", 1)
    return F.struct(F.when(digits != "", digits.cast("decimal(38,0)")).otherwise(F.lit(10**9).cast("decimal(38,0)")).alias("n"), text.alias("t"))


def resolve_name(tags: Column, override: Column) -> Column:
    """struct(display, source, status): an override, else the first of name:ru, official_name:ru, alt_name:ru that is not
    blank, else the name itself, marked for review."""
    tried = [("local_table", blank_to_null(override)), *((k, blank_to_null(tags[k])) for k in ("name:ru", "official_name:ru", "alt_name:ru"))]
    original = F.trim(F.coalesce(tags["name"], F.lit("")))
    source = F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for k, v in tried], F.lit("none"))
    status = F.when(source == "none", "needs_ru_review").otherwise("ok")
    return F.struct(F.coalesce(*[v for _, v in tried], original).alias("display"), source.alias("source"), status.alias("status"))


def reduction_pct(source: Column, candidate: Column) -> Column:
    return F.when(source <= 0, F.lit(0.0)).otherwise(F.round((1 - candidate / source) * 100, 2))
