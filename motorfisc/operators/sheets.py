"""Price-list sheets to canonical rows: header search, mapping, section banners, skip reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motorfisc.functions import categories as cat
from motorfisc.functions import numbers as num
from motorfisc.functions import text as txt
from motorfisc.session import settled, stored

#: Canonical fields that a mapping names a source column for.
FIELDS = [
    "brand", "model_name", "type_code", "full_name", "fuel", "price", "valid_from", "co2", "co2_min", "co2_max", "power_kw",
    "plug_in_range", "seats_7plus1", "seats_8plus1", "camper", "pickup_8704", "euro_norm",
]
SCAN_ROWS, BELOW_ROWS, LEAST_CELLS, MOST_NUMERIC, FILLED = 20, 20, 3, 0.3, 0.4
SHEET_CONFIDENCE, ROW_CONFIDENCE, SUBHEADER_ROWS = 0.6, 0.7, 5
_SHEET = ["file", "sheet"]


def populated(cells: DataFrame) -> DataFrame:
    """Cells with something in them, and whether that looks like a number."""
    numeric = F.when(F.col("kind") == "bool", False).otherwise((F.col("kind") == "num") | F.coalesce(num.numeric_like(F.col("value")), F.lit(False)))
    return cells.where(F.trim("value") != "").withColumn("numeric", numeric)


def header_rows(cells: DataFrame) -> DataFrame:
    """(file, sheet, header_row): the row among the first SCAN_ROWS whose columns the rows below fill best.

    A header has LEAST_CELLS cells or more, few of them numbers. Of several the one whose columns line up with most
    filled columns below wins, then the widest, then the first; a sheet without any has row 0.
    """
    full = populated(cells)
    sizes = cells.groupBy(*_SHEET).agg((F.max("row_idx") + 1).alias("n_rows"))
    heads = full.where(F.col("row_idx") < SCAN_ROWS)
    widths = heads.groupBy(*_SHEET, "row_idx").agg(F.count(F.lit(1)).alias("width"), F.count_if("numeric").alias("numbers"))
    able = widths.where((F.col("width") >= LEAST_CELLS) & (F.col("numbers") / F.col("width") < MOST_NUMERIC)).join(sizes, _SHEET)
    able = able.withColumn("below", F.least(F.lit(BELOW_ROWS), F.col("n_rows") - F.col("row_idx") - 1)).where("below > 0")
    h = heads.join(able, [*_SHEET, "row_idx"]).select(*_SHEET, "col_idx", F.col("row_idx").alias("head"), "width", "below")
    hits = h.join(full.where(F.col("row_idx") <= SCAN_ROWS + BELOW_ROWS).select(*_SHEET, "col_idx", "row_idx"), [*_SHEET, "col_idx"], "left")
    inside = (F.col("row_idx") > F.col("head")) & (F.col("row_idx") <= F.col("head") + BELOW_ROWS)
    columns = hits.groupBy(*_SHEET, "head", "width", "below", "col_idx").agg(F.count_if(inside).alias("filled"))
    lined_up = F.count_if(F.col("filled") >= F.greatest(F.lit(2), F.floor(F.col("below") * FILLED)))
    scores = columns.groupBy(*_SHEET, "head", "width").agg(lined_up.alias("aligned"))
    best = scores.groupBy(*_SHEET).agg(F.max_by("head", F.struct("aligned", "width", -F.col("head"))).alias("header_row"))
    return sizes.select(*_SHEET).join(best, _SHEET, "left").withColumn("header_row", F.coalesce("header_row", F.lit(0)))


def headers(cells: DataFrame) -> DataFrame:
    """(file, sheet, header_row, col_idx, name) of the header cells, and the sheet's fingerprint."""
    rows = cells.join(header_rows(cells), _SHEET).where("row_idx = header_row")
    named = rows.select(*_SHEET, "header_row", "col_idx", F.coalesce("value", F.lit("")).alias("name"))
    prints = named.groupBy(*_SHEET).agg(txt.header_fingerprint(F.collect_list("name")).alias("fingerprint"))
    return named.join(prints, _SHEET)


def mapped_columns(header: DataFrame, mapping: DataFrame) -> DataFrame:
    """(file, sheet, field, col_idx, price_currency, confidence) of the mapped columns that the sheet has.

    A mapping (fingerprint, status, field to header name, price_currency, confidence) counts if its status is ok and
    its confidence suffices. A name is looked for as it is, then with spelling evened out, the first such cell being
    meant; where a name occurs twice, its last column holds.
    """
    good = mapping.where((F.col("status") == "ok") & (F.col("confidence") >= SHEET_CONFIDENCE))
    fields = good.select("fingerprint", "price_currency", "confidence", F.explode("fields").alias("field", "wanted"))
    cells = header.join(fields, "fingerprint")
    exact, alike = F.col("name") == F.col("wanted"), (txt.header_cell(F.col("name")) == txt.header_cell(F.col("wanted"))) & (F.col("name") != "")
    by = Window.partitionBy(*_SHEET, "field")
    chosen = cells.withColumn("_name", F.coalesce(F.max(F.when(exact, F.col("name"))).over(by), F.min_by(F.when(alike, F.col("name")), F.when(alike, F.col("col_idx"))).over(by)))
    return chosen.where("name = _name").groupBy(*_SHEET, "header_row", "field", "price_currency", "confidence").agg(F.max("col_idx").alias("col_idx"), F.max("name").alias("name"))


def _typical_brand(rows: DataFrame) -> DataFrame:
    counts = rows.where(F.trim("brand") != "").groupBy(*_SHEET, F.lower(F.trim("brand")).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first"))
    return counts.groupBy(*_SHEET).agg(F.max_by("t", F.struct("n", -F.col("first"))).alias("typical"))


def wide_rows(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """One row for each data row of a mapped sheet, with a column for each field; no code by sheet.

    ``columns`` is what ``mapped_columns`` found.

    Cells are joined to the sheet's mapped columns and turned into a row by conditional aggregates, in one shuffle by
    row. ``texts`` counts the row's cells that aren't numbers, ``text_col`` is the column of one of them.
    """
    by_column = columns.groupBy(*_SHEET, "header_row", "price_currency", "confidence", "col_idx").agg(F.collect_set("field").alias("in_fields"))
    heads = columns.groupBy(*_SHEET, "header_row", "price_currency", "confidence").agg(F.max(F.when(F.col("field") == "price", F.col("name"))).alias("price_header"), F.max(F.when(F.col("field") == "brand", F.col("col_idx"))).alias("brand_col"), F.collect_set("field").alias("has"))
    data = cells.join(heads, _SHEET).where("row_idx > header_row")
    data = data.join(by_column.select(*_SHEET, "col_idx", "in_fields"), [*_SHEET, "col_idx"], "left")
    filled = F.coalesce(F.trim("value") != "", F.lit(False))
    numeric = F.when(F.col("kind") == "bool", False).otherwise((F.col("kind") == "num") | F.coalesce(num.numeric_like(F.col("value")), F.lit(False)))
    field = lambda f: F.max(F.when(F.array_contains("in_fields", f) & filled, F.col("value"))).alias(f)
    keys = [*_SHEET, "row_idx", "header_row", "price_currency", "confidence", "price_header", "brand_col", "has"]
    wide = data.groupBy(*keys).agg(*[field(f) for f in FIELDS], F.count_if(filled & ~numeric).alias("texts"), F.max(F.when(filled & ~numeric, F.col("col_idx"))).alias("text_col"))
    return wide.withColumn("offset", F.col("row_idx") - F.col("header_row") - 1)


def canonical_rows(cells: DataFrame, mapping: DataFrame, files: DataFrame, policy: str = "max") -> DataFrame:
    """Every data row with its canonical fields, or with the first reason for which it is skipped.

    ``files`` (file, default_valid_from) gives the day that a file's name tells. Section banners name the series of
    the rows below them.
    """
    # a few rows for each sheet, which everything below hangs on
    header = settled(headers(cells))
    described = family_descriptions(cells, header).withColumnRenamed("power_kw", "_kw")
    rows = wide_rows(cells, settled(mapped_columns(header, mapping))).join(files, "file", "left").join(described, [*_SHEET, "row_idx"], "left")
    rows = stored(rows)  # cells are turned into rows once
    rows = rows.join(_typical_brand(rows), _SHEET, "left")
    c = F.col
    has = lambda f: F.array_contains("has", f)
    banner = F.coalesce((c("texts") == 1) & (c("text_col") == c("brand_col")) & (F.lower(F.trim("brand")) != c("typical")), F.lit(False))
    by_row = Window.partitionBy(*_SHEET).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    below = F.when(c("offset") < SUBHEADER_ROWS, F.when(num.sheet_number(c("price")).isNull(), cat.header_currency(c("price"))))
    rows = rows.withColumn("banner", banner).withColumn("series", F.last(F.when(c("banner"), txt.series_text(F.trim("brand"), c("typical"))), ignorenulls=True).over(by_row))
    rows = rows.withColumn("below", F.min_by(below, F.when(below.isNotNull(), c("row_idx"))).over(Window.partitionBy(*_SHEET)))
    price, (power, boost) = num.sheet_number(c("price")), num.power(c("power_kw"))
    power = F.coalesce(power, F.when(~has("full_name"), c("_kw")))
    valid = F.coalesce(num.sheet_date(c("valid_from")), c("default_valid_from"))
    rows = rows.withColumn("_price", price).withColumn("_valid", valid).withColumn("currency", cat.price_currency(c("price_header"), c("below"), c("_valid"), c("price_currency")))
    rows = rows.withColumn("_co2", num.co2_of(num.sheet_number(c("co2")), num.sheet_number(c("co2_min")), num.sheet_number(c("co2_max")), policy))
    junk = F.when(has("model_name"), c("model_name").isNull()).otherwise(c("fuel").isNull() & c("price").isNull())
    reason = (
        F.when(c("banner"), "series_banner")
        .when(junk, "junk_row")
        .when(has("brand") & c("brand").isNull(), "missing_brand")
        .when(c("_price").isNull(), "missing_price")
        .when(c("_price") <= 0, "nonpositive_price")
        .when(c("_valid").isNull(), "missing_or_unparseable_valid_from")
        .when(~F.coalesce(c("currency").isin("EUR", "HRK"), F.lit(False)), "unrecognized_currency")
        .when(c("_co2").isNull(), "missing_co2")
    )
    fuel = cat.sheet_fuel(c("fuel"), boost, num.sheet_number(c("plug_in_range")))
    t = lambda f: F.nullif(F.trim(f), F.lit(""))
    return rows.withColumn("skip_reason", reason).select(
        *_SHEET, (c("offset") + 2).cast("int").alias("source_row"), "skip_reason", F.when(has("brand"), F.trim("brand")).otherwise("").alias("brand"), "series", t("model_name").alias("model_name"), t("type_code").alias("type_code"), F.coalesce(F.when(~has("full_name"), c("description")), t("full_name")).alias("full_name"),
        fuel.alias("fuel_category"), F.when(c("currency") == "HRK", num.eur_of_hrk(c("_price"))).otherwise(c("_price")).alias("price_eur"), "currency", c("_valid").alias("valid_from"), c("_co2").alias("co2_g_km"), power.alias("power_kw"), boost.alias("power_boost_kw"),
        num.truthy(c("camper")).alias("is_camper"), num.truthy(c("seats_7plus1")).alias("seats_7plus1"), num.truthy(c("seats_8plus1")).alias("seats_8plus1"), ((fuel == "unknown") | (c("confidence") < ROW_CONFIDENCE)).alias("needs_review"),
    )


def catalogue_rows(canonical: DataFrame, standard: Column) -> DataFrame:
    """Kept canonical rows as catalogue rows: what the engine text says of the fuel beats the cell; unusable rows go."""
    c = F.col
    model, name = F.coalesce("series", "model_name", "type_code", F.lit("unknown")), F.coalesce("full_name", "type_code", "model_name", F.lit("unknown"))
    text = F.concat_ws(" ", "brand", F.coalesce("model_name", "type_code", F.lit("unknown")), name)
    fuel = F.coalesce(cat.fuel_family(text, c("brand")), cat.stored_fuel(c("fuel_category")))
    rows = canonical.where("skip_reason is null").select(*_SHEET, "source_row", "brand", model.alias("model"), name.alias("variant"), "price_eur", "co2_g_km", standard.alias("co2_standard"), fuel.alias("fuel_type"), "power_kw", "valid_from", c("currency").alias("source_currency"))
    rows = rows.where("fuel_type is not null and co2_g_km is not null and brand <> ''").withColumn("match_key", txt.match_key(c("brand"), c("model"), c("variant")))
    last = F.row_number().over(Window.partitionBy("file", "match_key").orderBy(F.desc("sheet"), F.desc("source_row")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


# First words of the columns that together describe a row in sheets of one importer, and its code columns.
FAMILY_MARK, FAMILY_WORDS, FAMILY_CODES = "katashiki", ["motor", "karoserija", "mjenjac", "mjenjač", "oprema", "boja"], ["katashiki", "sfx"]


def family_descriptions(cells: DataFrame, header: DataFrame) -> DataFrame:
    """(file, sheet, row_idx, description, power_kw) of rows that only several cells describe together.

    Only sheets with a code column of that importer have such rows. The power is the one in the engine's cell.
    """
    plain = txt.header_cell(F.col("name"))
    named = header.withColumn("_plain", plain).withColumn("_of_family", F.max(F.contains("_plain", F.lit(FAMILY_MARK)).cast("int")).over(Window.partitionBy(*_SHEET)) == 1)
    code = F.exists(F.array(*[F.lit(x) for x in FAMILY_CODES]), lambda x: F.contains("_plain", x))
    place = F.when(F.split_part("_plain", F.lit(" "), F.lit(1)).isin(FAMILY_WORDS), 0).when(code, 1)
    columns = named.where("_of_family").withColumn("_place", place).where("_place is not null").select(*_SHEET, "header_row", "col_idx", "_place", F.startswith("_plain", F.lit("motor")).alias("_engine"))
    rows = cells.join(columns, [*_SHEET, "col_idx"]).where((F.col("row_idx") > F.col("header_row")) & (F.trim("value") != ""))
    parts = F.array_sort(F.collect_list(F.struct("_place", "col_idx", F.trim("value").alias("v"))))
    kw = F.max(F.when(F.col("_engine"), num.kw_in_text(F.col("value"))))
    out = rows.groupBy(*_SHEET, "row_idx").agg(parts.alias("parts"), F.replace(kw, F.lit(","), F.lit(".")).try_cast("double").alias("power_kw"))
    return out.select(*_SHEET, "row_idx", F.array_join(F.transform("parts", lambda p: p["v"]), " ").alias("description"), "power_kw")
