"""Price lists end to end: verdicts on sheets and files, one outcome for every row, brands snapped, and one committed write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorfisc.functions import categories as cat
from motorfisc.functions import text as txt
from motorfisc.operators import brands, sheets, upsert
from motorfisc.session import settled, stored
from motorfisc.sources import versions

c = F.col
_SHEET = ["file", "sheet"]
#: What a stored catalogue row is known by, and what it has.
KEYS = ["brand", "model", "variant", "valid_from"]
STORED = [*KEYS, "match_key", "price_eur", "co2_g_km", "co2_standard", "fuel_type", "power_kw", "source_file", "source_currency"]
KEPT = "kept"


def _wanted(header: DataFrame, mapping: DataFrame) -> DataFrame:
    """(file, sheet, field, wanted, there): the header names that a sheet's mapping asks for, and whether the sheet has them, however spelled."""
    fields = mapping.where("status = 'ok'").select("fingerprint", F.explode("fields").alias("field", "wanted")).where("wanted is not null")
    plain = lambda x: txt.header_cell(c(x))
    names = header.groupBy(*_SHEET, "fingerprint").agg(F.collect_set("name").alias("names"), F.collect_set(plain("name")).alias("plain"))
    there = F.array_contains("names", c("wanted")) | ((plain("wanted") != "") & F.array_contains("plain", plain("wanted")))
    return names.join(fields, "fingerprint").select(*_SHEET, "field", "wanted", there.alias("there"))


def verdicts(cells: DataFrame, mapping: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """(file, sheet, verdict, detail): ``ok``, or the first reason why nothing of a sheet can be read.

    In order: ``empty`` (no row below the header), ``blank_header``, ``no_mapping`` (no entry for the header's
    fingerprint), ``mapping_failed``, ``low_confidence``, ``no_price`` (no column for it), ``unknown_header``: the mapping
    names columns that the sheet lacks, which ``detail`` lists; none of the others is trusted then.
    """
    header = settled(sheets.headers(cells)) if header is None else header
    heads = header.groupBy(*_SHEET, "header_row", "fingerprint").agg(F.max(F.trim("name") != "").alias("named"))
    below = cells.join(header.select(*_SHEET, "header_row").distinct(), _SHEET, "left").where("header_row is null or row_idx > header_row").groupBy(*_SHEET).agg(F.max(F.coalesce(F.trim("value") != "", F.lit(False))).alias("filled"))
    known = mapping.groupBy("fingerprint").agg(F.max_by(F.struct("status", "confidence", F.map_contains_key("fields", F.lit("price")).alias("priced")), F.struct(c("status") == "ok", "confidence")).alias("m"))
    asked = _wanted(header, mapping).where("not there").groupBy(*_SHEET).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "field", "wanted"))), ", ").alias("lacking"))
    told = cells.select(*_SHEET).distinct().join(heads, _SHEET, "left").join(below, _SHEET, "left").join(known, "fingerprint", "left").join(asked, _SHEET, "left")
    verdict = (
        F.when(~F.coalesce("filled", F.lit(False)), "empty")
        .when(~F.coalesce("named", F.lit(False)), "blank_header")
        .when(c("m").isNull(), "no_mapping")
        .when(~F.coalesce(c("m.status") == "ok", F.lit(False)), "mapping_failed")
        .when(~F.coalesce(c("m.confidence") >= sheets.SHEET_CONFIDENCE, F.lit(False)), "low_confidence")
        .when(~F.coalesce("m.priced", F.lit(False)), "no_price")
        .when(c("lacking").isNotNull(), "unknown_header")
    )
    out = told.withColumn("verdict", F.coalesce(verdict, F.lit("ok")))
    return out.select(*_SHEET, "verdict", F.when(c("verdict") == "unknown_header", c("lacking")).alias("detail"))


def file_verdicts(files: DataFrame, of_sheets: DataFrame) -> DataFrame:
    """(file, verdict): ``ok``; ``no_valid_from`` where its name tells no day; ``no_usable_sheet`` where no sheet is ok or none was read."""
    usable = of_sheets.groupBy("file").agg(F.max((c("verdict") == "ok").cast("int")).alias("usable"))
    told = files.select("file", "default_valid_from").join(usable, "file", "left")
    return told.select("file", F.when(c("default_valid_from").isNull(), "no_valid_from").when(F.coalesce("usable", F.lit(0)) == 0, "no_usable_sheet").otherwise("ok").alias("verdict"))


def _snapped(rows: DataFrame) -> DataFrame:
    """Rows (folder, brand, ...) with the brand that their folder allows, or null; a folder without a list allows any."""
    keyed = rows.withColumn("id", F.to_json(F.struct(*_SHEET, "source_row")))
    found = brands.snapped(keyed.select("id", "folder", c("brand").alias("raw_brand"), F.concat_ws(" ", "full_name", "model_name", "series").alias("text")))
    listed = F.broadcast(brands.folders(rows.sparkSession).select("folder", F.lit(True).alias("listed")))
    own = keyed.join(found.withColumnRenamed("brand", "_brand"), "id").join(listed, "folder", "left")
    return own.withColumn("brand", F.when(c("listed"), c("_brand")).otherwise(c("brand"))).drop("id", "_brand", "listed")


def outcomes(cells: DataFrame, mapping: DataFrame, files: DataFrame, policy: str = "max") -> DataFrame:
    """Every data row of every sheet with ``outcome``: ``kept`` with its canonical fields, or why it isn't.

    ``files`` (file, folder, default_valid_from) are the manifest's. An outcome names the level that it comes from:
    ``file:``, ``sheet:`` or ``row:``; rows of files that the manifest lacks are ``file:unlisted``. Each row that has a
    cell with something in it, below its sheet's header (or in a sheet without one), has one outcome, so kept and
    quarantined rows add up to what was read.
    """
    header = settled(sheets.headers(cells))
    of_sheets = settled(verdicts(cells, mapping, header))
    of_files = file_verdicts(files, of_sheets).withColumnRenamed("verdict", "_file")
    heads = header.select(*_SHEET, "header_row").distinct()
    data = cells.where(F.trim("value") != "").join(heads, _SHEET, "left").where("header_row is null or row_idx > header_row")
    every = data.groupBy(*_SHEET, "row_idx", "header_row").agg(F.lit(1).alias("_one")).drop("_one")
    told = every.join(of_sheets.select(*_SHEET, "verdict"), _SHEET, "left").join(of_files, "file", "left")
    level = F.when(c("_file").isNull(), "file:unlisted").when(c("_file") == "no_valid_from", "file:no_valid_from").when(c("verdict") != "ok", F.concat(F.lit("sheet:"), c("verdict")))
    told = told.select(*_SHEET, "row_idx", (c("row_idx") - F.coalesce("header_row", F.lit(-1)) + 1).cast("int").alias("source_row"), level.alias("_level"))
    ok = of_sheets.where("verdict = 'ok'").select(*_SHEET).join(of_files.where("_file = 'ok'").select("file"), "file", "left_semi")
    read = sheets.canonical_rows(cells.join(ok, _SHEET, "left_semi"), mapping, files.select("file", "default_valid_from"), policy)
    rows = _snapped(stored(read.join(files.select("file", "folder"), "file")))  # looked at four times
    fuel = F.coalesce(cat.fuel_family(F.concat_ws(" ", "brand", F.coalesce("model_name", "type_code", F.lit("unknown")), F.coalesce("full_name", "type_code", "model_name", F.lit("unknown"))), c("brand")), cat.stored_fuel(c("fuel_category")))
    reason = F.when(c("skip_reason").isNotNull(), c("skip_reason")).when(c("brand").isNull(), "brand_not_allowed").when(c("brand") == "", "no_brand").when(fuel.isNull(), "no_fuel").when(c("co2_g_km").isNull(), "no_co2")
    rows = rows.withColumn("_row", F.coalesce(F.concat(F.lit("row:"), reason), F.lit(KEPT))).drop("folder")
    out = told.join(rows, [*_SHEET, "source_row"], "left")
    return out.withColumn("outcome", F.coalesce("_level", "_row", F.lit("row:unread"))).drop("_level", "_row", "skip_reason")


def catalogue_of(found: DataFrame, files: DataFrame) -> DataFrame:
    """Kept ``outcomes`` -> catalogue rows: the last one of a key in each file, then the last of a stored key (by file, sheet and row)."""
    year = files.select("file", F.year("default_valid_from").alias("_year"))
    kept = found.where(c("outcome") == KEPT).withColumn("skip_reason", F.lit(None).cast("string")).join(year, "file")
    rows = sheets.catalogue_rows(kept, cat.file_standard(c("_year"))).withColumn("source_file", c("file"))
    return upsert.last_by(rows, KEYS, [F.desc("file"), F.desc("sheet"), F.desc("source_row")]).select(*STORED)


def ingest(spark: SparkSession, path: str, cells: DataFrame, mapping: DataFrame, files: DataFrame, writer: str, batch: int) -> bool:
    """Puts what price lists say into the catalogue of versions at ``path``; False if the writer's batch is there already.

    Parts: ``rows``, the catalogue by KEYS, new rows in place of old ones of their key; ``quarantine``, this run's rows
    that weren't kept, with their outcome and cells; ``files``, this run's verdicts. All are committed together.
    """
    found = settled(outcomes(cells, mapping, files))
    new = settled(catalogue_of(found, files))
    data = cells.where(F.trim("value") != "").groupBy(*_SHEET, "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "value"))).alias("cells"))
    letters = found.where(c("outcome") != KEPT).select(*_SHEET, "row_idx", "source_row", "outcome").join(data, [*_SHEET, "row_idx"])

    def make(old):
        before = old("rows")
        rows = new if before is None else upsert.upserted(before, new, KEYS, [], [F.lit(0)])
        return {"rows": rows, "quarantine": letters, "files": file_verdicts(files, verdicts(cells, mapping))}

    return versions.commit(spark, path, make, writer, batch)
