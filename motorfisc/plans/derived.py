"""Inputs of the engine's jobs, derived from the given tables by one SQL text for Spark and DuckDB.

``{name}`` stands for a given table. ``ADD_MONTHS(date, n)`` and ``ADD_DAYS(date, n)`` are written as each engine has
them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from motorfisc.session import table

_OFFERS = """
SELECT offer_id, price_eur, CASE WHEN fuel_type = 'electric' THEN 0 ELSE co2 END AS co2_g_km, fuel_type, first_registration_date,
       ADD_DAYS(ADD_MONTHS(first_registration_date, age), extra_days) AS declaration_date, eaer_city_range_km, seat_count, is_camper, is_new_vehicle
FROM (
  SELECT l_orderkey * 1000 + l_partkey % 1000 AS offer_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS price_eur,
         CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'diesel' WHEN p_type = 'STANDARD' THEN 'electric' ELSE 'petrol' END AS fuel_type,
         CAST(60 + (l_partkey * 37 + l_linenumber * 11) % 240 AS DECIMAL(7,2)) AS co2,
         ADD_MONTHS(CAST(o_orderdate AS DATE), 264) AS first_registration_date,
         CAST((l_partkey * 13) % 400 AS INT) AS age, CAST(l_suppkey % 28 AS INT) AS extra_days,
         CASE WHEN l_partkey % 11 = 0 THEN CAST(l_quantity * 2.5 AS DECIMAL(7,2)) END AS eaer_city_range_km,
         CAST(4 + l_suppkey % 6 AS INT) AS seat_count, l_partkey % 53 = 0 AS is_camper, l_returnflag = 'N' AND l_linestatus = 'F' AS is_new_vehicle
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
)"""



def pick(place: str, values: list[str | None]) -> str:
    """The value at ``place`` (any whole number) modulo their number, as a CASE that both engines have."""
    told = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE CAST({place} AS BIGINT) % {len(values)} " + " ".join(f"WHEN {i} THEN {told(v)}" for i, v in enumerate(values)) + " END"


RAW_BRANDS = ["BMW", "vw", "Škoda", "Mercedes", "MINI", "Mazda", "toyota", " ALFA  Romeo", "Audi", "Lynk&Co", "Citroen", "Trabant"]
MODELS = ["320d", "120i", "A4", "A3", "Octavia", "CX-5", "Corolla", "Serija 3 (F30)", "X1", "Giulia"]
BADGES = ["xDrive20d", "40TDI", "45TFSI", "2.0i", "2.2d", "G120", "TS Hybrid", "1.5 TSI", "1.4 D-CVVT", "SKYACTIV-D 150", "PHEV", "1.5 dCi 110"]
TRIMS = ["S tr", "Avant", "Advantage", "Steptronic", "Sportback quattro", "Limuzina ručni", "Automatik", "cross", "Kombi 4x4", "Gran Coupé", "Touring_8stupnjevaprijenosa_5vrata_140kW"]
FUELS = ["D", "B", "MH", "H", "E", "G", "BENZIN EURO 6", "dizel", "Diesel", None, "električni"]

_CARS = f"""
SELECT p_partkey AS id, {pick("p_partkey", RAW_BRANDS)} AS raw_brand, {pick("floor(p_partkey / 12)", MODELS)} AS model,
       concat({pick("floor(p_partkey / 7)", BADGES)}, ' ', {pick("floor(p_partkey / 5)", TRIMS)}, CASE WHEN p_partkey % 3 = 0 THEN concat(' ', p_name) ELSE '' END) AS variant,
       {pick("floor(p_partkey / 3)", FUELS)} AS fuel_raw, CAST(CAST(round(p_retailprice * 20, 2) AS DECIMAL(12,2)) AS DOUBLE) AS price_eur,
       CAST(90 + (p_partkey * 7) % 150 AS DOUBLE) AS co2_g_km, CASE WHEN p_partkey % 17 <> 0 THEN CAST(60 + p_size * 4 AS DOUBLE) END AS power_kw,
       CASE WHEN p_type IN ('PROMO', 'ECONOMY', 'LARGE') THEN 'diesel' ELSE 'petrol' END AS fuel_type,
       ADD_DAYS(DATE '2013-01-01', day_no) AS valid_from, p_name, p_type, p_brand
FROM (SELECT *, CAST((p_partkey * 97) % 4300 AS INT) AS day_no FROM {{part}}) p"""

_NUMBERS = f"""
SELECT p_partkey AS id, CASE CAST(p_partkey AS BIGINT) % 10 WHEN 0 THEN concat(a, '.', b, ',', c) WHEN 1 THEN concat(a, ',', b, '.', c) WHEN 2 THEN concat(a, '.', b) WHEN 3 THEN concat(a, ',', '0')
         WHEN 4 THEN concat(a, ',', b, ' ') WHEN 5 THEN 'n/a' WHEN 6 THEN concat(a, '.', b, '.', b) WHEN 7 THEN concat('  ', a, '.', c, ' ') WHEN 8 THEN '' ELSE concat(a, '*') END AS text,
       CASE CAST(p_partkey AS BIGINT) % 5 WHEN 0 THEN concat(a, '+', c) WHEN 1 THEN concat(a, '*') WHEN 2 THEN concat(a, ',5') WHEN 3 THEN concat('1.6 (', a, ' kW)') ELSE a END AS power,
       concat(a, '.', b, ' km') AS mileage, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_size AS DOUBLE) END AS low, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_size + 7 AS DOUBLE) END AS high, p_retailprice, p_size
FROM (SELECT *, CAST(p_size + 10 AS STRING_TYPE) AS a, lpad(CAST(p_partkey * 7 % 1000 AS STRING_TYPE), 3, '0') AS b, lpad(CAST(p_partkey % 100 AS STRING_TYPE), 2, '0') AS c FROM {{part}}) p"""

_DATES = """
SELECT p_partkey AS id, CASE CAST(p_partkey AS BIGINT) % 12 WHEN 0 THEN concat(d, '.', m, '.', y) WHEN 1 THEN concat(d, '. ', m, '. ', y, '.') WHEN 2 THEN concat(y, '-', m, '-', d, 'T00:00:00.000Z') WHEN 3 THEN concat(d, '/', m, '/', y)
         WHEN 4 THEN concat(m, '.', y) WHEN 5 THEN concat(m, '/', y) WHEN 6 THEN concat(y, '-', m) WHEN 7 THEN y WHEN 8 THEN 'soon' WHEN 9 THEN concat(d, '.', m, '.', substr(y, 3, 2)) WHEN 10 THEN concat('32.', m, '.', y) ELSE '' END AS text,
       CASE CAST(p_partkey AS BIGINT) % 12 WHEN 0 THEN concat('BMW,MINI ', d, '.', m, '.', y, '..xlsx') WHEN 1 THEN concat('VOLVO ', y, ' ', d, '.', m, '..xlsx') WHEN 2 THEN concat('Dacia ', y, m, d, '.xls') WHEN 3 THEN concat('BMW ', y, ' ', m, d, '.xlsx')
         WHEN 4 THEN concat('toyota', y, '_', m, d, '.xlsx') WHEN 5 THEN concat('Dacia - ', y, ' ', m, '.xls') WHEN 6 THEN concat('Suzuki_', y, '-', m, '-', d, '.xls') WHEN 7 THEN concat('Mazda (', d, '_', m, '_', substr(y, 3, 2), ').xls') WHEN 8 THEN concat('Chevrolet ', d, m, y, '.xls')
         WHEN 9 THEN concat('Opel_', d, '.', m, '..xls') WHEN 10 THEN concat('Renault ', y, ' ', d, m, '.xls') ELSE concat('Brand ', y, '1301.xlsx') END AS file_name, CASE WHEN p_partkey % 24 < 12 THEN CAST(y AS INT) END AS folder_year,
       CASE CAST(p_partkey AS BIGINT) % 4 WHEN 0 THEN y WHEN 1 THEN concat(y, '-', m) WHEN 2 THEN concat(y, '/', m) END AS period
FROM (SELECT p_partkey, CAST(2012 + (p_partkey * 3) % 19 AS STRING_TYPE) AS y, lpad(CAST(1 + (p_partkey * 5) % 13 AS STRING_TYPE), 2, '0') AS m, lpad(CAST(1 + (p_partkey * 11) % 31 AS STRING_TYPE), 2, '0') AS d FROM {part}) p"""

_ENGINES = f"""
SELECT p_partkey AS engine_id, {pick("floor(p_partkey / 3)", ["BMW", "Volkswagen", "Mazda", "Toyota"])} AS brand, concat({pick("floor(p_partkey / 3)", ["BMW", "Volkswagen", "Mazda", "Toyota"])}, ' ', {pick("floor(p_partkey / 12)", ["F30", "E90", "Golf VII", "Golf VIII", "CX-5", "Corolla", "X1"])}) AS title,
       {pick("p_partkey", ["320d", "320i", "318d xDrive", "2.0 TDI", "1.5 TSI", "G120", "D150 Skyactiv", None, "1.8 Hybrid"])} AS engine_code,
       CASE CAST(p_partkey AS BIGINT) % 7 WHEN 0 THEN NULL WHEN 1 THEN CAST(2008 + p_size % 10 AS STRING_TYPE) WHEN 2 THEN 'ab 2010' ELSE concat(CAST(2008 + p_size % 10 AS STRING_TYPE), '-', lpad(CAST(1 + p_partkey % 12 AS STRING_TYPE), 2, '0')) END AS production_start,
       CASE CAST(p_partkey AS BIGINT) % 5 WHEN 0 THEN NULL ELSE concat(CAST(2013 + p_size % 9 AS STRING_TYPE), '-', lpad(CAST(1 + p_partkey % 12 AS STRING_TYPE), 2, '0')) END AS production_end,
       CAST(CASE WHEN p_partkey % 23 = 0 THEN 150 ELSE 1200 + 100 * (p_partkey % 20) END AS DOUBLE) AS displacement_cc, CASE WHEN p_partkey % 19 <> 0 THEN CAST(CASE WHEN p_partkey % 61 = 1 THEN 0 ELSE 70 + (p_partkey * 7) % 120 END AS DOUBLE) END AS power_kw,
       {pick("floor(p_partkey / 2)", ["diesel", "petrol", None])} AS fuel_type, CASE WHEN p_partkey % 13 <> 0 THEN CAST(100 + (p_partkey * 3) % 90 AS DOUBLE) END AS co2_min, CASE WHEN p_partkey % 17 <> 0 THEN CAST(CASE WHEN p_partkey % 71 = 2 THEN 610 ELSE 104 + (p_partkey * 3) % 90 + p_size % 9 - CASE WHEN p_partkey % 8 = 0 THEN 60 ELSE 0 END END AS DOUBLE) END AS co2_max,
       {pick("p_partkey", ["confirmed", "refiled", "confirmed", "confirmed", "unverified"])} AS brand_check, concat('https://example.org/wiki/', CAST(p_partkey % 100 AS STRING_TYPE)) AS source_url, md5(CAST(p_partkey % 1600 AS STRING_TYPE)) AS source_fingerprint, CAST(p_partkey % 2 AS INT) AS variant_index
FROM {{part}}"""

_VEHICLES = f"""
SELECT s_suppkey AS vehicle_id, {pick("s_suppkey", ["BMW", "Volkswagen", "Mazda", "Toyota"])} AS brand, {pick("floor(s_suppkey / 4)", ["320d F30", "Golf VII 2.0 TDI", "CX-5 D150", "Corolla 1.8", "X1 318d xDrive", ""])} AS v_model,
       {pick("s_suppkey", ["Diesel", "benzin", None, "hybrid", "TDI"])} AS v_fuel, CASE WHEN s_suppkey % 9 <> 0 THEN CAST(80 + (s_suppkey * 11) % 90 AS DOUBLE) END AS v_power, CASE WHEN s_suppkey % 3 = 0 THEN CAST(1968 AS DOUBLE) END AS v_cc,
       CASE WHEN s_suppkey % 8 <> 0 THEN ADD_DAYS(DATE '2012-01-01', d) END AS registered
FROM (SELECT *, CAST((s_suppkey * 61) % 3600 AS INT) AS d FROM {{supplier}}) s"""

_CRAWLED = f"""
SELECT engine_id, {pick("engine_id", ["BMW", "Subaru", "Volkswagen", "BMW"])} AS crawl_brand, {pick("engine_id", ["BMW 3er F30", "Opel Astra G", "VW Golf VII", "601 Kombi", "BMW i3"])} AS title, engine_code, production_start, production_end,
       displacement_cc, power_kw, fuel_type, co2_min, co2_max, source_url, source_fingerprint, variant_index
FROM ({_ENGINES}) e"""

SQL = {"engines": _ENGINES, "crawled": _CRAWLED, "vehicles": _VEHICLES, "offers": _OFFERS, "cars": _CARS, "number_texts": _NUMBERS, "date_texts": _DATES}


def duck(text: str) -> str:
    """The text as DuckDB has it."""
    text = re.sub(r"ADD_MONTHS\((.*?), (\w+)\)", r"CAST(\1 + to_months(\2) AS DATE)", text)
    text = re.sub(r"ADD_DAYS\((.*), (\w+)\)( END)? AS", r"CAST(\1 + to_days(\2) AS DATE)\3 AS", text)
    return re.sub(r"\{(\w+)\}", r"\1", text).replace("STRING_TYPE", "VARCHAR")


def _spark(text: str) -> str:
    return text.replace("ADD_DAYS(", "date_add(").replace("ADD_MONTHS(", "add_months(").replace("STRING_TYPE", "STRING")


def derive(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """The input; with ``spread`` it is laid out in many tasks, however few files its tables have: their rows are small, the texts laid out from them are not."""
    parts = re.split(r"(\{\w+\})", _spark(SQL[name]))
    # braces that name no table stand for themselves
    text = "".join(p if i % 2 else p.replace("{", "{{").replace("}", "}}") for i, p in enumerate(parts))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    read = lambda t: table(spark, sf_dir, t).repartition(tasks, *table(spark, sf_dir, t).columns[:1]) if spread else table(spark, sf_dir, t)
    return spark.sql(text, **{t: read(t) for t in {p[1:-1] for p in parts[1::2]}})
