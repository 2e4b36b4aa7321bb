"""Sheet ingestion over ``part`` laid out as price-list sheets, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorfisc.functions import categories as cat
from motorfisc.functions import dims
from motorfisc.functions import text as txt
from motorfisc.operators import ingest, sheets
from motorfisc.plans import twins as tw
from motorfisc.plans.derived import SQL, derive, duck
from motorfisc.session import checkpoint_folder, stored
from motorfisc.sources import versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _rows() -> str:
    """What the sheets hold, as SQL for both engines: brand, model, full name, fuel, price, emission, power, day."""
    base = SQL["cars"]
    return f"""
SELECT p_brand AS file, CASE WHEN id % 2 = 0 THEN 'A' ELSE 'B' END AS sheet, id, CAST(row_number() OVER (PARTITION BY p_brand, id % 2 ORDER BY id) + 1 AS INT) AS row_idx,
  CASE WHEN id % 9 = 0 THEN concat('Bmw serije ', model, ' (F40)') WHEN id % 41 = 1 THEN NULL ELSE 'BMW' END AS c0,
  CASE WHEN id % 9 = 0 OR id % 43 = 2 THEN NULL ELSE model END AS c1, CASE WHEN id % 9 = 0 THEN NULL ELSE variant END AS c2, CASE WHEN id % 9 = 0 THEN NULL ELSE fuel_raw END AS c3,
  CASE WHEN id % 9 = 0 THEN NULL WHEN id % 37 = 3 THEN 'na upit' WHEN id % 47 = 4 THEN '0' ELSE CAST(CAST(floor(price_eur) AS BIGINT) AS STRING_TYPE) END AS c4,
  CASE WHEN id % 9 = 0 OR id % 29 = 5 THEN NULL WHEN id % 4 = 1 THEN concat(CAST(CAST(co2_g_km AS BIGINT) AS STRING_TYPE), '*') ELSE CAST(CAST(co2_g_km AS BIGINT) AS STRING_TYPE) END AS c5,
  CASE WHEN id % 9 = 0 OR power_kw IS NULL THEN NULL WHEN id % 6 = 1 THEN concat(CAST(CAST(power_kw AS BIGINT) AS STRING_TYPE), '+16') ELSE CAST(CAST(power_kw AS BIGINT) AS STRING_TYPE) END AS c6,
  CASE WHEN id % 9 = 0 OR id % 53 = 6 THEN NULL WHEN id % 5 = 0 THEN 'uskoro' ELSE concat(CAST(1 + id % 28 AS STRING_TYPE), '.', CAST(1 + id % 12 AS STRING_TYPE), '.2019.') END AS c7
FROM ({base}) cars"""


SQL["sheet_rows"] = _rows()
HEADER = ["MARKA", "MODEL", "PUNI NAZIV", "GORIVO", "CIJENA (kn)", "CO2\n(g/km)", "KW", "VRIJEDI OD:"]
FIELDS = ["brand", "model_name", "full_name", "fuel", "price", "co2", "power_kw", "valid_from"]


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, sheet, row_idx, col_idx, value, kind): a title, a header and the rows of each sheet."""
    rows = derive(spark, sf_dir, "sheet_rows")
    cells = rows.select("file", "sheet", "row_idx", F.posexplode(F.array(*[f"c{i}" for i in range(len(HEADER))])).alias("col_idx", "value"))
    names = rows.select("file", "sheet").distinct()
    title = names.select("file", "sheet", F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("Cjenik 2019").alias("value"))
    head = names.select("file", "sheet", F.lit(1).alias("row_idx"), F.posexplode(F.array(*[F.lit(h) for h in HEADER])).alias("col_idx", "value"))
    numeric = F.col("value").rlike("^[0-9]+$")
    return stored(title.unionByName(head).unionByName(cells).withColumn("kind", F.when(numeric, "num").otherwise("str")))


def mapping(spark: SparkSession) -> DataFrame:
    """The mapping of the one layout that the sheets have, learned from a header spelled otherwise."""
    wanted = {f: (h.replace("\n", " ") if f == "co2" else h) for f, h in zip(FIELDS, HEADER, strict=True)}
    df = spark.createDataFrame([("ok", "HRK", 0.65, wanted)], "status string, price_currency string, confidence double, fields map<string,string>")
    return df.withColumn("fingerprint", txt.header_fingerprint(F.array(*[F.lit(h) for h in HEADER])))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = derive(spark, sf_dir, "sheet_rows").select("file").distinct()
    return names.withColumn("default_valid_from", F.when(F.col("file") != "Brand#7", F.lit("2018-06-01").cast("date")))


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_R = f"r AS ({duck(SQL['sheet_rows'])})"
_PRICE = tw.sheet_number("c4")
_VALID = "coalesce(CASE WHEN c7 IS NOT NULL AND c7 <> 'uskoro' THEN TRY_CAST('2019-' || lpad(CAST(1 + id % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + id % 28 AS VARCHAR), 2, '0') AS DATE) END, CASE WHEN file <> 'Brand#7' THEN DATE '2018-06-01' END)"
_REASON = f"CASE WHEN id % 9 = 0 THEN 'series_banner' WHEN c1 IS NULL THEN 'junk_row' WHEN c0 IS NULL THEN 'missing_brand' WHEN {_PRICE} IS NULL THEN 'missing_price' WHEN {_PRICE} <= 0 THEN 'nonpositive_price' WHEN {_VALID} IS NULL THEN 'missing_or_unparseable_valid_from' WHEN c5 IS NULL THEN 'missing_co2' END"
_FUEL = f"coalesce({tw.case('upper(trim(c3))', dims.FUEL_LETTERS, 'NULL')}, {tw.case('lower(trim(c3))', dims.FUEL_WORDS, 'NULL')}, CASE WHEN c3 = 'BENZIN EURO 6' THEN 'petrol' END)"
_CANON = f"""WITH {_R}, canon AS (SELECT file, sheet, CAST(row_idx AS INT) AS source_row, {_REASON} AS skip_reason, trim(c0) AS brand,
  last_value(CASE WHEN id % 9 = 0 THEN trim(regexp_replace(substr(c0, 5), '\\(F40\\)$', '')) END IGNORE NULLS) OVER (PARTITION BY file, sheet ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS series,
  c1 AS model_name, c2 AS full_name, CASE WHEN {_FUEL} IS NULL THEN 'unknown' WHEN {_FUEL} = 'petrol' AND contains(c6, '+') THEN 'petrol_hybrid' ELSE {_FUEL} END AS fuel_category,
  CAST(round(CAST({_PRICE} AS DECIMAL(30,12)) / CAST('7.53450' AS DECIMAL(8,5)), 2) AS DOUBLE) AS price_eur, {_VALID} AS valid_from, {tw.sheet_number('c5')} AS co2_g_km, {tw.sheet_number("split_part(c6, '+', 1)")} AS power_kw FROM r)"""


@_query(f"WITH {_R} SELECT DISTINCT file, sheet, 1 AS header_row FROM r")
def win1_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header row of each sheet."""
    return sheets.header_rows(sheet_cells(spark, sf_dir))


@_query(f"WITH {_R}, x AS (SELECT file, sheet, row_idx, unnest([c0, c1, c2, c3, c4, c5, c6, c7]) AS v FROM r) SELECT file, sheet, row_idx, count(v) AS filled FROM x GROUP BY ALL HAVING count(v) > 0")
def src2_sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled cells of each data row."""
    cells = sheet_cells(spark, sf_dir).where("row_idx > 1")
    return sheets.populated(cells).groupBy("file", "sheet", "row_idx").agg(F.count(F.lit(1)).alias("filled"))


@_query(f"WITH {_R}, s AS (SELECT DISTINCT file, sheet FROM r) SELECT file, sheet, f AS field, i AS col_idx FROM s, (VALUES {', '.join(f'({chr(39)}{f}{chr(39)}, {i})' for i, f in enumerate(FIELDS))}) t(f, i)")
def jn8_flt5_mapped_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column of each canonical field, found by the header's fingerprint."""
    return sheets.mapped_columns(sheets.headers(sheet_cells(spark, sf_dir)), mapping(spark)).select("file", "sheet", "field", "col_idx")


@_query(f"{_CANON} SELECT * FROM canon WHERE skip_reason IS NULL")
def job2_canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows of all sheets."""
    rows = sheets.canonical_rows(sheet_cells(spark, sf_dir), mapping(spark), files(spark, sf_dir)).where("skip_reason is null")
    return rows.select("file", "sheet", "source_row", "skip_reason", "brand", "series", "model_name", "full_name", "fuel_category", "price_eur", "valid_from", "co2_g_km", "power_kw")


@_query(f"{_CANON} SELECT skip_reason, count(*) AS n FROM canon GROUP BY ALL")
def flt3_agg3_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the first reason for which they are skipped."""
    return sheets.canonical_rows(sheet_cells(spark, sf_dir), mapping(spark), files(spark, sf_dir)).groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"))


_STORED = "CASE fuel_category WHEN 'diesel' THEN 'diesel' WHEN 'petrol' THEN 'petrol' WHEN 'petrol_hybrid' THEN 'petrol' WHEN 'petrol_plug_in_hybrid' THEN 'petrol' END"
_TEXT = "(brand || ' ' || model_name || ' ' || full_name)"


@_query(f"{_CANON}, k AS (SELECT file, sheet, source_row, brand, coalesce(series, model_name) AS model, full_name AS variant, price_eur, co2_g_km, coalesce({tw.engine_word_fuel(_TEXT)}, {tw.badge_fuel(_TEXT, 'brand')}, {_STORED}) AS fuel_type FROM canon WHERE skip_reason IS NULL) SELECT *, {tw.match_key('brand', 'model', 'variant')} AS match_key FROM k WHERE fuel_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file, {tw.match_key('brand', 'model', 'variant')} ORDER BY sheet DESC, source_row DESC) = 1")
def job3_catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows of all sheets, the last one of a key in each file."""
    canonical = sheets.canonical_rows(sheet_cells(spark, sf_dir), mapping(spark), files(spark, sf_dir))
    rows = sheets.catalogue_rows(canonical, cat.file_standard(F.lit(2019)))
    return rows.select("file", "sheet", "source_row", "brand", "model", "variant", "price_eur", "co2_g_km", "fuel_type", "match_key")


#: Layouts of sheets besides the first one: header names that differ, and what there is of a mapping for them.
_OTHER = {
    "renamed": ({"full_name": "TRGOVAČKI NAZIV"}, ("ok", 0.9, {})),
    "unmapped": ({"full_name": "OPIS"}, None),
    "unsure": ({"full_name": "NAZIV VOZILA"}, ("ok", 0.5, {})),
    "invented": ({"full_name": "IME"}, ("ok", 0.9, {"model_name": "NEMA"})),
}
_NUMBER = "CAST(substr(file, 7) AS INT)"
_LAYOUT = f"CASE WHEN {_NUMBER} % 5 = 0 THEN 'renamed' WHEN {_NUMBER} % 5 = 2 AND sheet = 'B' THEN 'unmapped' WHEN {_NUMBER} % 5 = 3 AND sheet = 'A' THEN 'unsure' WHEN {_NUMBER} % 5 = 4 THEN 'invented' ELSE 'first' END"
_FOLDER = f"CASE {_NUMBER} % 4 WHEN 0 THEN 'bmw-mini' WHEN 1 THEN 'toyota' WHEN 2 THEN 'citroën-ds' ELSE 'elsewhere' END"


def _header(layout: str) -> list[str]:
    return [_OTHER[layout][0].get(f, h) for f, h in zip(FIELDS, HEADER, strict=True)]


def sheets_of_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of ``sheet_cells`` in several layouts: other header names, and in one of them the columns the other way round."""
    names = F.create_map(*[F.lit(x) for k in _OTHER for x in (f"{k}/{FIELDS.index('full_name')}", _OTHER[k][0]["full_name"])])
    laid = sheet_cells(spark, sf_dir).withColumn("layout", F.expr(_LAYOUT))
    renamed = F.when(F.col("row_idx") == 1, F.try_element_at(names, F.concat_ws("/", "layout", F.col("col_idx").cast("string"))))
    turned = F.when((F.col("layout") == "renamed") & (F.col("row_idx") > 0), len(HEADER) - 1 - F.col("col_idx")).otherwise(F.col("col_idx"))
    return laid.select("file", "sheet", "row_idx", turned.alias("col_idx"), F.coalesce(renamed, "value").alias("value"), "kind")


def mappings(spark: SparkSession) -> DataFrame:
    """The mappings of the layouts that have one."""
    out = mapping(spark)
    for name, (_, entry) in _OTHER.items():
        if entry:
            status, confidence, wrong = entry
            fields = dict(zip(FIELDS, _header(name), strict=True)) | wrong
            df = spark.createDataFrame([(status, "HRK", confidence, fields)], "status string, price_currency string, confidence double, fields map<string,string>")
            out = out.unionByName(df.withColumn("fingerprint", txt.header_fingerprint(F.array(*[F.lit(h) for h in _header(name)]))))
    return out


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).withColumn("folder", F.expr(_FOLDER))


_SNAP = f"CASE {_NUMBER} % 4 WHEN 1 THEN 'Toyota' WHEN 2 THEN NULL ELSE brand END"
_OUTCOMES = f"""{_CANON}, s AS (SELECT * REPLACE ({_SNAP} AS brand), {_LAYOUT} AS layout FROM canon), f AS (SELECT *, coalesce({tw.engine_word_fuel(_TEXT)}, {tw.badge_fuel(_TEXT, 'brand')}, {_STORED}) AS fuel_type FROM s),
o AS (SELECT *, CASE WHEN file = 'Brand#7' THEN 'file:no_valid_from' WHEN layout = 'unmapped' THEN 'sheet:no_mapping' WHEN layout = 'unsure' THEN 'sheet:low_confidence' WHEN layout = 'invented' THEN 'sheet:unknown_header' WHEN skip_reason IS NOT NULL THEN 'row:' || skip_reason WHEN brand IS NULL THEN 'row:brand_not_allowed' WHEN fuel_type IS NULL THEN 'row:no_fuel' ELSE 'kept' END AS outcome FROM f)"""


@_query(f"{_OUTCOMES} SELECT file, sheet, outcome, count(*) AS n FROM o GROUP BY ALL")
def job3_flt22_flt24_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of sheets in five layouts by what became of them: kept, or quarantined by file, sheet or row."""
    found = ingest.outcomes(sheets_of_layouts(spark, sf_dir), mappings(spark), manifest(spark, sf_dir))
    return found.groupBy("file", "sheet", "outcome").agg(F.count(F.lit(1)).alias("n"))


@_query(f"{_OUTCOMES}, k AS (SELECT *, coalesce(series, model_name) AS model, full_name AS variant FROM o WHERE outcome = 'kept'), m AS (SELECT *, {tw.match_key('brand', 'model', 'variant')} AS match_key FROM k QUALIFY row_number() OVER (PARTITION BY file, {tw.match_key('brand', 'model', 'variant')} ORDER BY sheet DESC, source_row DESC) = 1) SELECT brand, model, variant, valid_from, match_key, price_eur, co2_g_km, 'NEDC' AS co2_standard, fuel_type, power_kw, file AS source_file FROM m QUALIFY row_number() OVER (PARTITION BY brand, model, variant, valid_from ORDER BY file DESC, sheet DESC, source_row DESC) = 1")
def job3_snk1_ingested_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue after an ingest of all sheets: read, snapped to the folder's brands, put in by key."""
    path = f"{checkpoint_folder(spark)}/catalogue-{uuid4().hex}"
    ingest.ingest(spark, path, sheets_of_layouts(spark, sf_dir), mappings(spark), manifest(spark, sf_dir), "ingest", 0)
    return versions.read(spark, path).select("brand", "model", "variant", "valid_from", "match_key", "price_eur", "co2_g_km", "co2_standard", "fuel_type", "power_kw", "source_file")
