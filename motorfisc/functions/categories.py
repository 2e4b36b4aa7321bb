"""Keyword classifiers as column expressions; null where a text says nothing or contradicts itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorfisc.functions import dims
from motorfisc.functions.text import let, mapping, normalized, tokens, words


def _one_of(first: Column, second: Column, a: str, b: str) -> Column:
    return let(F.struct(first.alias("a"), second.alias("b")), lambda x: F.when(x["a"] & ~x["b"], a).when(x["b"] & ~x["a"], b))


def _has(text: Column, values: list[str]) -> Column:
    return F.arrays_overlap(tokens(text), words(values))


def engine_word_fuel(text: Column) -> Column:
    """diesel or petrol by the names of engine families."""
    return let(normalized(text), lambda n: _one_of(_has(n, dims.DIESEL_WORDS) | n.rlike(r"\bskyactiv d\d{0,3}\b"), _has(n, dims.PETROL_WORDS) | n.rlike(r"\bskyactiv [gx]\d{0,3}\b"), "diesel", "petrol"))


def badge_fuel(text: Column, brand: Column) -> Column:
    """diesel or petrol by a badge: 320d, 2.0i, and for one brand G120 or CD175."""
    raw = F.coalesce(text, F.lit(""))
    mazda = F.coalesce(F.lower(F.trim(brand)) == "mazda", F.lit(False))
    return let(normalized(text), lambda n: _badge(n, raw, mazda))


def _badge(n: Column, raw: Column, mazda: Column) -> Column:
    diesel = n.rlike(r"\b\d{2,3}d\b") | raw.rlike(r"(?i)\b\d\.\d\s*d\b(?!-)") | (mazda & n.rlike(r"\b(cd|d)\d{2,3}\b"))
    petrol = n.rlike(r"\b\d{2,3}i\b") | raw.rlike(r"(?i)\b\d\.\d\s*i\b(?!-)") | (mazda & n.rlike(r"\b[gx]\d{2,3}\b"))
    return _one_of(diesel, petrol, "diesel", "petrol")


def fuel_family(text: Column, brand: Column) -> Column:
    return F.coalesce(engine_word_fuel(text), badge_fuel(text, brand))


def site_fuel(raw: Column) -> Column:
    return F.try_element_at(mapping(dims.LISTING_FUEL), F.lower(F.trim(raw)))


def tax_fuel(raw: Column) -> Column:
    """The fuel that a listing is taxed by: petrol, diesel or electric; null for spellings that the tax doesn't know."""
    return F.try_element_at(mapping(dims.TAX_FUEL), F.lower(F.trim(raw)))


def query_fuel(raw: Column, model: Column, variant: Column, brand: Column) -> Column:
    """A listing's fuel: engine words, else what the site says, else a badge."""
    text = F.concat(F.coalesce(model, F.lit("")), F.lit(" "), F.coalesce(variant, F.lit("")))
    return F.coalesce(engine_word_fuel(text), site_fuel(raw), badge_fuel(text, brand))


def sheet_fuel(raw: Column, boost_kw: Column, range_km: Column) -> Column:
    """Fuel category of a sheet's cell."""
    t = F.trim(raw)
    letters, spelled = mapping(dims.FUEL_LETTERS), mapping(dims.FUEL_WORDS)
    read = lambda x: F.coalesce(F.try_element_at(letters, F.upper(x)), F.try_element_at(spelled, F.lower(x)))
    told = F.coalesce(read(t), read(F.regexp_replace(t, r"(?i)\s+euro\s*[0-9].*$", "")))
    return let(told, lambda base: F.when(base.isNull(), "unknown").when((base == "petrol") & (range_km > 0), "petrol_plug_in_hybrid").when((base == "petrol") & (boost_kw > 0), "petrol_hybrid").otherwise(base))


def stored_fuel(category: Column) -> Column:
    return F.when(category == "diesel", "diesel").when(category.isin("petrol", "petrol_hybrid", "petrol_plug_in_hybrid"), "petrol")


def corpus_fuel(raw: Column) -> Column:
    return F.try_element_at(mapping(dims.CORPUS_FUEL), F.lower(F.trim(raw)))


def gearbox(text: Column) -> Column:
    return let(normalized(text), lambda n: _one_of(_has(n, dims.MANUAL_WORDS), _has(n, dims.AUTO_WORDS), "manual", "auto"))


def bodies(text: Column) -> Column:
    return F.array_intersect(tokens(text), words(dims.BODY_WORDS))


def drivetrains(text: Column) -> Column:
    return F.array_intersect(tokens(text), words(dims.DRIVETRAIN_WORDS))


def header_currency(header: Column) -> Column:
    """EUR or HRK as a price header says."""
    kuna = F.array_contains(F.regexp_extract_all(F.lower(header), F.lit("([a-zčćžšđ]+)"), F.lit(1)), "kn")
    return F.when(header.rlike("(?i)eur|€"), "EUR").when(kuna, "HRK")


def price_currency(header: Column, below: Column, valid_from: Column, mapped: Column) -> Column:
    """Header, then a cell below it, then the euro's first day, then the mapping."""
    return F.coalesce(header_currency(header), below, F.when(valid_from >= F.lit(dims.EURO_FROM).cast("date"), "EUR"), mapped)


def file_standard(year: Column) -> Column:
    return F.when(year >= 2021, "WLTP").otherwise("NEDC")
