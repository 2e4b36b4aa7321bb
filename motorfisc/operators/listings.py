"""Listing rows out of pages and payloads: label and value pairs, JSON blocks, actor items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorfisc.functions import numbers as num
from motorfisc.functions import text as txt

c = F.col
# Labels of listing pages in several languages, in the order in which a contained one is looked for.
LABELS = {
    "erstzulassung": "first_registration", "first registration": "first_registration", "kraftstoff": "fuel_type", "fuel": "fuel_type", "kraftstoffart": "fuel_type", "kilometerstand": "mileage_km", "laufleistung": "mileage_km", "mileage": "mileage_km",
    "leistung": "power_kw", "power": "power_kw", "sitze": "seat_count", "seats": "seat_count", "anzahl der sitze": "seat_count", "version": "variant", "variante": "variant", "ausstattung": "variant", "trim": "variant", "marke": "brand", "hersteller": "brand",
    "make": "brand", "fahrzeugmarke": "brand", "modell": "model", "model": "model", "fahrzeugmodell": "model", "datum prve registracije": "first_registration", "prva registracija": "first_registration", "gorivo": "fuel_type", "vrsta goriva": "fuel_type",
    "kilometraža": "mileage_km", "prijeđeni km": "mileage_km", "snaga motora": "power_kw", "snaga": "power_kw", "broj sjedala": "seat_count", "sjedala": "seat_count", "verzija": "variant", "oprema": "variant", "marka": "brand", "proizvođač": "brand",
    "godište": "year", "godina": "year", "co2 emisija": "co2", "co2": "co2", "emisija co2": "co2", "variant": "variant", "brand": "brand", "broj sasije": "vin", "vin broj": "vin", "chassis number": "vin", "vin number": "vin",
    "fahrzeug-identifizierungsnummer": "vin", "vehicle identification no": "vin", "identifikacijski broj vozila": "vin",
    "fin": "vin", "fahrgestellnummer": "vin", "vehicle identification number": "vin", "vin": "vin", "broj šasije": "vin",
}
# Fuel codes and words of listing sites; those of the actor are looked for in this order.
CODE_FUEL = {"b": "petrol", "d": "diesel", "e": "electric", "2": "petrol", "3": "diesel", "l": "petrol", "c": "petrol", "m": "petrol", "diesel": "diesel", "petrol": "petrol", "gasoline": "petrol", "benzin": "petrol", "electric": "electric", "lpg": "petrol", "cng": "petrol", "hybrid": "petrol", "plug-in hybrid": "petrol", "mild hybrid": "petrol"}
PAGE_FUEL = {"diesel": "diesel", "benzin": "petrol", "petrol": "petrol", "benzin/gas": "petrol", "hybrid": "hybrid", "elektro": "electric", "electric": "electric", "erdgas": "cng"}
ACTOR_FUEL = [("elektro/diesel", "diesel"), ("electric/diesel", "diesel"), ("elektro/benzin", "petrol"), ("electric/petrol", "petrol"), ("hybrid (diesel", "diesel"), ("hybrid (benzin", "petrol"), ("diesel mildhybrid", "diesel"), ("benzin mildhybrid", "petrol"), ("diesel", "diesel"), ("petrol", "petrol"), ("benzin", "petrol"), ("gasoline", "petrol"), ("elektro", "electric"), ("electric", "electric"), ("autogas", "petrol"), ("lpg", "petrol"), ("erdgas", "petrol"), ("cng", "petrol"), ("ethanol", "petrol"), ("hybrid", "petrol")]
_PAIRS = {
    "dl": r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>",
    "tr": r"(?is)<tr[^>]*>\s*<t[hd][^>]*>(.*?)</t[hd]>\s*<t[hd][^>]*>(.*?)</t[hd]>",
    "li": r"(?is)<li[^>]*>([^:<]+):((?:(?!</li>).)*)</li>",
}


def _plain(markup: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "(?s)<[^>]*>", ""), r"(&nbsp;|[\s ])+", " "))


def spec_pairs(pages: DataFrame) -> DataFrame:
    """(page_id, shape, pos, label, value): definition lists, two-cell rows and items with a colon."""
    shapes = [
        pages.select("page_id", F.lit(shape).alias("shape"), F.posexplode(F.arrays_zip(F.regexp_extract_all("html", F.lit(p), F.lit(1)).alias("label"), F.regexp_extract_all("html", F.lit(p), F.lit(2)).alias("value"))).alias("pos", "x"))
        for shape, p in _PAIRS.items()
    ]
    pairs = shapes[0].unionByName(shapes[1]).unionByName(shapes[2])
    label = F.regexp_replace(F.lower(_plain(c("x.label"))), ":+$", "")
    return pairs.select("page_id", "shape", "pos", label.alias("label"), _plain(c("x.value")).alias("value")).where("label <> '' AND (shape <> 'li' OR value <> '')")


def labelled_fields(pairs: DataFrame) -> DataFrame:
    """(page_id, field, value): the field that a label names, by itself or by the first known label in it.

    Of several pairs for a field the exact label wins, then lists and tables over items, then page order.
    """
    known = pairs.sparkSession.createDataFrame([(k, f, i) for i, (k, f) in enumerate(LABELS.items())], "known string, field string, nth int")
    hits = pairs.join(F.broadcast(known), (c("label") == c("known")) | F.contains("label", c("known")))
    exact = (c("label") == c("known")).cast("int")
    one = F.row_number().over(Window.partitionBy("page_id", "shape", "pos").orderBy(F.desc("_exact"), "nth"))
    fields = hits.withColumn("_exact", exact).withColumn("_n", one).where("_n = 1")
    first = F.row_number().over(Window.partitionBy("page_id", "field").orderBy(F.desc("_exact"), F.when(c("shape") == "li", 1).otherwise(0), "pos"))
    return fields.withColumn("_m", first).where("_m = 1").select("page_id", "field", "value")


def page_listings(pages: DataFrame) -> DataFrame:
    """Listing rows of detail pages; what a page doesn't say is null."""
    wide = labelled_fields(spec_pairs(pages)).groupBy("page_id").pivot("field", sorted(set(LABELS.values()))).agg(F.first("value"))
    own = pages.select("page_id", "url", F.nullif(F.regexp_extract("html", r"([0-9][0-9.,]+)\s*€", 1), F.lit("")).alias("_price")).join(wide, "page_id", "left")
    kw = F.nullif(F.regexp_extract("power_kw", r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*kw", 1), F.lit(""))
    hp = F.nullif(F.regexp_extract("power_kw", r"(?i)([0-9]+)\s*(?:ks|hp|ps|cv)", 1), F.lit("")).try_cast("double")
    km = F.nullif(F.regexp_extract("mileage_km", r"(?i)([0-9][0-9.,]*)\s*(?:km|kilomet)", 1), F.lit(""))
    seats = F.nullif(F.regexp_extract("seat_count", "([0-9]+)", 1), F.lit("")).try_cast("int")
    co2 = F.nullif(F.regexp_extract("co2", r"([0-9]+(?:[.,][0-9]+)?)", 1), F.lit(""))
    return own.select(
        "page_id", txt.site_of(c("url")).alias("source_site"), txt.listing_id(c("url")).alias("listing_id"), "brand", "model", "variant", num.display_number(c("_price")).alias("price_eur"), num.listing_date(c("first_registration")).alias("registered"),
        F.coalesce(num.display_number(kw), F.round(hp * 0.7355, 1)).alias("power_kw"), num.display_number(km).cast("int").alias("mileage_km"), F.when(seats.between(1, 20), seats).alias("seat_count"), F.try_element_at(txt.mapping(PAGE_FUEL), F.lower(F.trim("fuel_type"))).alias("fuel_type"), txt.vin(c("vin")).alias("vin"), num.display_number(co2).alias("co2_g_km"),
    )


def json_ld(pages: DataFrame) -> DataFrame:
    """(page_id, brand, model, price): the first linked-data block of a car or vehicle in a page."""
    found = F.regexp_extract_all("html", F.lit(r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    blocks = pages.select("page_id", F.posexplode(found).alias("pos", "raw")).withColumn("kind", F.lower(F.get_json_object("raw", "$['@type']"))).where(c("kind").isin("car", "vehicle"))
    one = blocks.groupBy("page_id").agg(F.min_by("raw", "pos").alias("raw"))
    get = lambda p: F.get_json_object("raw", p)
    return one.select("page_id", F.coalesce(get("$.brand.name"), get("$.brand")).alias("brand"), get("$.model").alias("model"), get("$.offers.price").try_cast("double").alias("price_eur"))


def state_listings(payloads: DataFrame) -> DataFrame:
    """Listing rows of pages' JSON state: the listing is looked for in four places, its fields in several forms."""
    v = F.try_parse_json("payload")
    at = lambda p: F.try_variant_get("v", f"$.props.pageProps{p}", "variant")
    found = F.coalesce(at(".listingDetails.vehicle"), at(".listing"), at(".data.listing"), at(".item"))
    own = payloads.withColumn("v", v).withColumn("x", found).withColumn("p", at(".listingDetails"))
    get = lambda name, kind, *paths: F.coalesce(*[F.try_variant_get(name, f"$.{p}", kind) for p in paths])
    text = lambda *paths: get("x", "string", *paths)
    number = lambda *paths: get("x", "double", *paths)
    codes = txt.mapping(CODE_FUEL)
    fuel = F.coalesce(*[F.try_element_at(codes, F.lower(F.trim(F.try_variant_get("x", f"$.{p}", "string")))) for p in ("fuelCategory.raw", "fuel.id", "fuel.key", "fuelCategory.key", "fuel")])
    suffix = F.lower(F.regexp_extract(F.trim(text("modelVersionInput")), r"^([a-zA-Z]{1,3})(?:\s|$)", 1))
    suffix = F.when(suffix.rlike("^x[die]$"), F.substring(suffix, 2, 1)).otherwise(suffix)
    base = text("model.name", "model.label", "model")
    seats = number("seats", "numberOfSeats", "specs.seats")
    offer = F.upper(F.trim(text("offerType")))
    return own.select(
        "url", text("make.name", "make.label", "make").alias("brand"), F.when((suffix != "") & ~F.endswith(F.lower(base), suffix), F.concat(base, suffix)).otherwise(base).alias("model"), text("version", "trim", "variant", "versionId", "modelVersionInput").alias("variant"),
        F.coalesce(get("p", "double", "prices.public.priceRaw"), number("prices.public.priceRaw", "prices[0].value", "price.value", "price")).alias("price_eur"), fuel.alias("fuel_type"), number("rawPowerInKw", "engine.power.kw", "power.kw", "kw").alias("power_kw"),
        number("mileageInKmRaw", "mileage.value", "mileage", "km").cast("int").alias("mileage_km"), number("co2emissionInGramPerKmWithFallback.raw", "co2Emission.value", "emissionCo2.value", "co2").alias("co2_g_km"), F.when(seats.between(1, 20), seats.cast("int")).alias("seat_count"), F.when(offer == "N", True).when(offer == "U", False).alias("is_new"),
    )


ACTOR_SCHEMA = "manufacturer string, model string, subTitle string, vin string, price struct<amount double>, properties struct<firstRegistration string, power string, co2Emission string, fuelType string, milage string, emissionClass string, vin string>"


def actor_listings(items: DataFrame) -> DataFrame:
    """Listing rows of an actor's dataset items."""
    own = items.withColumn("x", F.from_json("payload", ACTOR_SCHEMA))
    p = "x.properties."
    power = F.when(F.contains(c(p + "power"), F.lit("kW")), F.element_at(F.split(F.trim(F.split_part(c(p + "power"), F.lit("kW"), F.lit(1))), r"\s+"), -1))
    fuel = F.coalesce(*[F.when(F.contains(F.lower(p + "fuelType"), F.lit(k)), v) for k, v in ACTOR_FUEL])
    return own.select(
        "item_id", c("x.manufacturer").alias("brand"), c("x.model").alias("model"), c("x.subTitle").alias("variant"), c("x.price.amount").alias("price_eur"), num.listing_date(c(p + "firstRegistration")).alias("registered"), num.display_number(power).alias("power_kw"),
        num.display_number(F.replace(c(p + "co2Emission"), F.lit("g/km"), F.lit(""))).alias("co2_g_km"), fuel.alias("fuel_type"), F.trim(F.regexp_replace(c(p + "milage"), "[.,]|km", "")).try_cast("int").alias("mileage_km"), txt.vin(F.coalesce(p + "vin", "x.vin")).alias("vin"),
    )
