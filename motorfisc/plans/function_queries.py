"""Scalar functions and classifiers as columns over tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorfisc.functions import categories as cat
from motorfisc.functions import dims, folding
from motorfisc.functions import numbers as num
from motorfisc.functions import text as txt
from motorfisc.plans import twins as tw
from motorfisc.plans.derived import SQL, derive, duck
from motorfisc.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _columns(name: str, source: str, key: str, /, **made: tuple[Callable[[], Column], str]) -> None:
    """Registers a query that adds columns to a source, and the same columns in SQL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = derive(spark, sf_dir, source) if source in SQL else table(spark, sf_dir, source)
        return df.select(key, *[column().alias(k) for k, (column, _) in made.items()])

    query.__name__ = name
    QUERIES[name] = query
    rows = f"({duck(SQL[source])}) AS s" if source in SQL else source
    ORACLES[name] = f"SELECT {key}, {', '.join(f'{sql} AS {k}' for k, (_, sql) in made.items())} FROM {rows}"


c = F.col
_columns("str1_unmarked", "cars", "id", plain=(lambda: txt.unmarked(c("variant")), tw.unmarked("variant")), brand=(lambda: txt.unmarked(c("raw_brand")), tw.unmarked("raw_brand")))
_columns("str2_normalized", "cars", "id", norm=(lambda: txt.normalized(c("variant")), tw.normalized("variant")))
_columns("str3_match_key", "cars", "id", key=(lambda: txt.match_key(c("raw_brand"), c("model"), c("variant")), tw.match_key("raw_brand", "model", "variant")))
_columns("str4_corpus_text", "benchmark", "item_id", plain=(lambda: txt.corpus_text(c("text")), tw.corpus_text("text")))
_columns("str5_fold", "cars", "id", folded=(lambda: txt.fold(c("raw_brand")), tw.fold("raw_brand")))
_slug = lambda x: tw.gsub(tw.gsub(x, "[^\\p{L}\\p{N}]+", "-"), "^-+|-+$", "")
_columns("str6_slugs", "cars", "id", brand_slug=(lambda: txt.brand_slug(c("raw_brand")), _slug(tw.fold("raw_brand"))), file_slug=(lambda: txt.file_slug(c("variant")), tw.gsub(tw.gsub("lower(trim(variant))", "[^\\p{L}\\p{N}_-]+", "-"), "^-+|-+$", "")), ascii_slug=(lambda: txt.ascii_slug(c("variant")), tw.gsub(tw.gsub(tw.unmarked("variant"), "[^a-z0-9]+", "-"), "^-+|-+$", "")))
_cells_s = lambda: F.array(F.concat(F.lit(" "), F.upper(c("p_type")), F.lit(": ")), F.lit("CO2\n(g/km)"), F.concat(c("p_brand"), F.lit(" .")), F.lit(""), F.lit("co2 (g/km)"), c("p_name"))
_cells_d = "[' ' || upper(p_type) || ': ', 'CO2' || chr(10) || '(g/km)', p_brand || ' .', '', 'co2 (g/km)', p_name]"
_cell_d = tw.gsub(tw.gsub("lower(trim(h))", "[ \\t\\n\\r]+", " "), "^[ .:\\-]+|[ .:\\-]+$", "")
_columns("str7_header_cells", "cars", "id", cells=(lambda: F.array_join(F.transform(_cells_s(), txt.header_cell), "|"), f"array_to_string(list_transform({_cells_d}, lambda h: {_cell_d}), '|')"))
_columns("str8_header_fingerprint", "cars", "id", fingerprint=(lambda: txt.header_fingerprint(_cells_s()), f"sha1(array_to_string(list_sort(list_distinct(list_filter(list_transform({_cells_d}, lambda h: {_cell_d}), lambda x: x <> ''))), chr(1)))"))
_columns("str9_table_fingerprint", "documents", "doc_id", fingerprint=(lambda: F.sha1(F.concat_ws("\n", "source", "text")), "sha1(concat_ws(chr(10), source, text))"))
_columns("str10_client_hash", "events", "event_id", hashed=(lambda: txt.client_hash(F.concat(c("user_id").cast("string"), F.lit(" , 10.0.0.1")), "salt"), "sha256('salt' || CAST(user_id AS VARCHAR))"))
_key_s, _key_d = lambda: txt.match_key(c("raw_brand"), c("model"), c("variant")), tw.match_key("raw_brand", "model", "variant")
_columns("str11_str12_query_key", "cars", "id", key=(lambda: txt.query_key(c("raw_brand"), _key_s()), tw.query_key("raw_brand", _key_d)))
_columns("str18_leading_digits", "cars", "id", digits=(lambda: txt.leading_digits(c("model")), "nullif(regexp_extract(trim(model), '^(\\d+)', 1), '')"))
_text_s, _text_d = lambda: txt.corpus_text(F.concat_ws(" ", "model", "variant")), tw.corpus_text("concat_ws(' ', model, variant)")
_merged = tw.tokens(tw.gsub("' ' || replace(" + _text_d + ", ' ', '  ') || ' '", " ([a-z])  (\\d{3}) ", " \\1\\2 "))
_columns("str19_designators", "cars", "id", found=(lambda: F.array_join(F.array_sort(txt.designators(_text_s())), " "), f"array_to_string(list_sort(list_distinct(list_concat(list_filter({_merged}, lambda t: regexp_matches(t, '^([a-z]\\d{{1,2}}|\\d{{3}}[a-z]{{1,2}}|[a-z]\\d{{3}})$')), list_filter(({_merged})[1:1], lambda t: regexp_matches(t, '^\\d{{3}}$'))))), ' ')"))
_told = f"NOT list_contains({tw.quoted(dims.NOISE_TOKENS)}, t) AND NOT regexp_matches(t, '^[ivxl]+$') AND CASE WHEN regexp_matches(t, '^\\p{{L}}+$') THEN length(t) >= 4 ELSE length(t) >= 5 AND regexp_matches(t, '\\p{{L}}') END"
_columns("str20_set3_extra_tokens", "cars", "id", extra=(lambda: txt.extra_tokens(txt.corpus_text(c("model")), _text_s()), f"len(list_filter(list_distinct({tw.tokens(_text_d)}), lambda t: NOT list_contains({tw.tokens(tw.corpus_text('model'))}, t) AND {_told}))"))
_seg = "list_filter(list_transform(string_split(variant, '_'), lambda x, i: {'s': trim(x), 'i': i}), lambda x: x.s <> '' AND lower(x.s) NOT IN ('benzin', 'benzina', 'diesel', 'dizel', 'gasoline', 'hybrid') AND NOT regexp_matches(x.s, '(?i)^\\d+\\s*(kw|ccm)$'))"
_one = "CASE WHEN x.i = 1 THEN regexp_replace(x.s, '(?i)^(bmw|mini)\\s+', '') ELSE x.s END"
_shown = f"CASE WHEN regexp_matches(x.s, '(?i)^\\d+\\s*stupnjeva') THEN regexp_extract(x.s, '^(\\d+)', 1) || '-stup.' WHEN regexp_matches(x.s, '(?i)^\\d+\\s*vrata$') THEN regexp_extract(x.s, '^(\\d+)', 1) || ' vrata' ELSE upper(substr({_one}, 1, 1)) || substr({_one}, 2) END"
_columns("str22_display", "cars", "id", shown=(lambda: txt.variant_display(c("raw_brand"), c("variant")), f"CASE WHEN NOT contains(variant, '_') THEN variant WHEN lower(trim(raw_brand)) IN ('bmw', 'mini') THEN array_to_string(list_transform({_seg}, lambda x: {_shown}), ' · ') ELSE trim(regexp_replace(replace(variant, '_', ' '), '\\s+', ' ', 'g')) END"))
_columns("str23_corrected_kw", "cars", "id", shown=(lambda: txt.corrected_kw(c("variant"), c("power_kw")), "CASE WHEN regexp_matches(variant, '(?i)\\d+kw$') AND power_kw IS NOT NULL AND CAST(regexp_extract(variant, '(?i)(\\d+)kw$', 1) AS INT) <> CAST(power_kw AS INT) THEN regexp_replace(variant, '(?i)\\d+kw$', '') || CAST(CAST(power_kw AS INT) AS VARCHAR) || regexp_extract(variant, '(?i)\\d+(kw)$', 1) ELSE variant END"))
_columns("str24_series_text", "cars", "id", series=(lambda: txt.series_text(F.concat(F.upper(F.trim("raw_brand")), F.lit(" "), c("model")), F.lower(F.trim("raw_brand"))), "CASE WHEN trim(regexp_replace(model, '\\(\\s*[A-Za-z0-9]+\\s*\\)\\s*$', '')) <> '' THEN trim(regexp_replace(model, '\\(\\s*[A-Za-z0-9]+\\s*\\)\\s*$', '')) END"))
_columns("str25_page_title", "cars", "id", title=(lambda: txt.page_title(F.lower(F.regexp_replace("variant", " ", "_"))), "upper(substr(trim(regexp_replace(replace(lower(variant), '_', ' '), '\\s+', ' ', 'g')), 1, 1)) || substr(trim(regexp_replace(replace(lower(variant), '_', ' '), '\\s+', ' ', 'g')), 2)"))
_columns("str27_source_url", "cars", "id", url=(lambda: F.concat(F.lit("https://example.org/wiki/"), F.replace(F.col("variant"), F.lit(" "), F.lit("_"))), "'https://example.org/wiki/' || replace(variant, ' ', '_')"))
_columns("str28_str29_sites_and_ids", "pages", "page_id", site=(lambda: txt.site_of(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("https://suchen.mobile.de/", "https://www.autoscout24.de/", "https://autobid.de/", "")]), (c("page_id") % 4 + 1).cast("int")), c("url"))), "CASE page_id % 4 WHEN 0 THEN 'mobile.de' WHEN 1 THEN 'autoscout24' WHEN 2 THEN 'autobid.de' END"), listing=(lambda: txt.listing_id(c("url")), "coalesce(nullif(regexp_extract(url, '[?&]id=(\\d+)', 1), ''), nullif(regexp_extract(url, '/(\\d+)\\.html', 1), ''))"))
_columns("str31_vin", "cars", "id", vin=(lambda: txt.vin(F.concat(F.lit(" wba"), F.lpad((c("id") * 7919).cast("string"), 9, "0"), F.when(c("id") % 5 == 0, "o").otherwise("x"))), "CASE WHEN id % 5 <> 0 THEN 'WBA' || lpad(CAST(id * 7919 AS VARCHAR), 9, '0') || 'X' END"))
_columns("str34_display_formats", "number_texts", "id", day=(lambda: F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), c("p_size")), "d.M.yyyy."), "strftime(DATE '2020-01-01' + CAST(p_size AS INT), '%-d.%-m.%Y.')"))
_columns("cat1_engine_word_fuel", "cars", "id", fuel=(lambda: cat.engine_word_fuel(c("variant")), tw.engine_word_fuel("variant")))
_columns("cat2_badge_fuel", "cars", "id", fuel=(lambda: cat.badge_fuel(F.concat_ws(" ", "model", "variant"), c("raw_brand")), tw.badge_fuel("concat_ws(' ', model, variant)", "raw_brand")))
_columns("cat3_query_fuel", "cars", "id", fuel=(lambda: cat.query_fuel(c("fuel_raw"), c("model"), c("variant"), c("raw_brand")), tw.query_fuel("fuel_raw", "model", "variant", "raw_brand")))
_sheet_fuel_d = f"CASE WHEN b IS NULL THEN 'unknown' WHEN b = 'petrol' AND id % 4 = 0 THEN 'petrol_plug_in_hybrid' WHEN b = 'petrol' AND id % 5 = 0 THEN 'petrol_hybrid' ELSE b END FROM (SELECT id, coalesce({tw.case('upper(trim(fuel_raw))', dims.FUEL_LETTERS, 'NULL')}, {tw.case('lower(trim(fuel_raw))', dims.FUEL_WORDS, 'NULL')}, {tw.case('''lower(regexp_replace(trim(fuel_raw), '(?i)[ ]+euro ?[0-9].*$', ''))''', dims.FUEL_WORDS, 'NULL')}) AS b FROM ({duck(SQL['cars'])})) AS s"
_columns("cat4_sheet_fuel", "cars", "id", fuel=(lambda: cat.sheet_fuel(c("fuel_raw"), F.when(c("id") % 5 == 0, 16.0), F.when(c("id") % 4 == 0, 50.0)), "''"))
ORACLES["cat4_sheet_fuel"] = f"SELECT id, {_sheet_fuel_d.replace(' FROM (SELECT id', ' AS fuel FROM (SELECT id', 1)}"
_columns("cat5_stored_fuel", "cars", "id", fuel=(lambda: F.coalesce(cat.fuel_family(F.concat_ws(" ", "raw_brand", "model", "variant"), c("raw_brand")), cat.stored_fuel(cat.sheet_fuel(c("fuel_raw"), F.lit(None).cast("double"), F.lit(None).cast("double")))), f"coalesce({tw.engine_word_fuel('''concat_ws(' ', raw_brand, model, variant)''')}, {tw.badge_fuel('''concat_ws(' ', raw_brand, model, variant)''', 'raw_brand')}, CASE WHEN upper(fuel_raw) IN ('D', 'DIZEL', 'DIESEL') THEN 'diesel' WHEN upper(fuel_raw) IN ('B', 'MH', 'H', 'BENZIN EURO 6') THEN 'petrol' END)"))
_TAX_SPELLINGS = "CASE WHEN {0} IN ('diesel', 'dizel') THEN 'diesel' WHEN {0} IN ('petrol', 'benzin', 'gasoline', 'lpg', 'cng', 'hybrid') THEN 'petrol' WHEN {0} IN ('electric', 'elektrisch', 'elektro') THEN 'electric' END"
_columns("cat6_cat7_fuel_maps", "cars", "id", tax=(lambda: cat.tax_fuel(c("fuel_raw")), _TAX_SPELLINGS.format("lower(trim(fuel_raw))")), site=(lambda: cat.site_fuel(c("fuel_raw")), tw.case("lower(trim(fuel_raw))", dims.LISTING_FUEL, "NULL")), corpus=(lambda: cat.corpus_fuel(c("fuel_raw")), tw.case("lower(trim(fuel_raw))", dims.CORPUS_FUEL, "NULL")))
_columns("cat8_gearbox", "cars", "id", gearbox=(lambda: cat.gearbox(c("variant")), tw.gearbox("variant")))
_columns("cat9_body_sets", "cars", "id", bodies=(lambda: F.array_join(F.array_sort(cat.bodies(_key_s())), " "), f"array_to_string(list_sort(list_distinct(list_filter({tw.tokens(_key_d)}, lambda t: list_contains({tw.quoted(dims.BODY_WORDS)}, t)))), ' ')"), drivetrains=(lambda: F.array_join(F.array_sort(cat.drivetrains(_key_s())), " "), f"array_to_string(list_sort(list_distinct(list_filter({tw.tokens(_key_d)}, lambda t: list_contains({tw.quoted(dims.DRIVETRAIN_WORDS)}, t)))), ' ')"))
_header_s = lambda: F.element_at(F.array(*[F.lit(x) for x in ("CIJENA (EUR)", "osnovna_cijena_kn", "MPC (s trošarinom)", "knjiga", "Preporučena (€)")]), (c("id") % 5 + 1).cast("int"))
_columns("cat10_currency", "cars", "id", currency=(lambda: cat.price_currency(_header_s(), F.when(c("id") % 7 == 0, "HRK"), c("valid_from"), F.lit("HRK")), "CASE WHEN id % 5 IN (0, 4) THEN 'EUR' WHEN id % 5 = 1 THEN 'HRK' WHEN id % 7 = 0 THEN 'HRK' WHEN valid_from >= DATE '2023-01-01' THEN 'EUR' ELSE 'HRK' END"))
_columns("cat11_file_standard", "cars", "id", standard=(lambda: cat.file_standard(F.year("valid_from")), "CASE WHEN year(valid_from) >= 2021 THEN 'WLTP' ELSE 'NEDC' END"))
_columns("num5_display_number", "number_texts", "id", x=(lambda: num.display_number(c("text")), tw.display_number("text")))
_columns("num6_sheet_number", "number_texts", "id", x=(lambda: num.sheet_number(c("text")), tw.sheet_number("text")))
_columns("num7_power", "number_texts", "id", base=(lambda: num.power(c("power"))[0], tw.sheet_number("split_part(power, '+', 1)")), boost=(lambda: num.power(c("power"))[1], f"CASE WHEN contains(power, '+') THEN {tw.sheet_number('split_part(power, chr(43), 2)')} END"), in_text=(lambda: num.kw_in_text(c("power")), "nullif(regexp_extract(power, '(?i)([0-9]+(?:[.,][0-9]+)?)\\s*kw\\b', 1), '')"))
_columns("num8_co2", "number_texts", "id", highest=(lambda: num.co2_of(F.lit(1.0), c("low"), c("high")), "coalesce(high, low, 1.0)"), lowest=(lambda: num.co2_of(F.lit(1.0), c("low"), c("high"), "min"), "coalesce(low, high, 1.0)"), mean=(lambda: num.co2_of(F.lit(1.0), c("low"), c("high"), "average"), "coalesce((low + high) / 2, high, low, 1.0)"))
_columns("num9_eur_of_hrk", "number_texts", "id", eur=(lambda: num.eur_of_hrk(c("p_retailprice") * 20), "CAST(round(CAST(round(CAST(p_retailprice * 20 AS DECIMAL(18,4)), 4) AS DECIMAL(30,12)) / CAST('7.53450' AS DECIMAL(8,5)), 2) AS DOUBLE)"))
_columns("num12_mileage", "number_texts", "id", km=(lambda: num.bare_mileage(c("mileage")), "TRY_CAST(nullif(regexp_replace(mileage, '[^0-9]', '', 'g'), '') AS INT)"))
_columns("num13_ramps", "cars", "id", power=(lambda: num.ramp(F.abs(c("power_kw") - 150), *dims.POWER_RAMP), tw.ramp("abs(power_kw - 150)", *dims.POWER_RAMP)), year=(lambda: num.ramp(F.abs(F.year("valid_from") - 2019).cast("double"), *dims.YEAR_RAMP), tw.ramp("CAST(abs(year(valid_from) - 2019) AS DOUBLE)", *dims.YEAR_RAMP)), fade=(lambda: num.fade(F.abs(c("power_kw") - 150), 3.0, 8.0, 30.0), "CASE WHEN abs(power_kw - 150) <= 3 THEN 30.0 WHEN abs(power_kw - 150) >= 8 THEN 0.0 WHEN power_kw IS NULL THEN NULL ELSE 30.0 * (8.0 - abs(power_kw - 150)) / 5.0 END"))
_columns("num18_predicates", "number_texts", "id", numeric=(lambda: num.numeric_like(c("text")), "regexp_matches(regexp_replace(trim(text), '[., ]', '', 'g'), '^[0-9]+$')"), yes=(lambda: num.truthy(F.element_at(F.array(*[F.lit(x) for x in ("da", " X ", "0", "yes", "ne")]), (c("id") % 5 + 1).cast("int"))), "id % 5 IN (0, 1, 3)"))
_n = "regexp_replace(trim(text), '\\s*([./])\\s*', '\\1', 'g')"
_x = lambda p, g: f"regexp_extract({_n}, '{p}', {g})"
_shapes = [("^(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})\\.?$", 3, 2, 1), ("^(\\d{1,2})/(\\d{1,2})/(\\d{4})$", 3, 2, 1), ("^(\\d{1,2})[./](\\d{4})$", 2, 1, 0), ("^(\\d{4})-(\\d{1,2})$", 1, 2, 0), ("^(\\d{4})$", 1, 0, 0)]
_iso = "CASE WHEN regexp_matches(left(trim(text), 10), '^\\d{4}-\\d{2}-\\d{2}$') THEN TRY_CAST(left(trim(text), 10) AS DATE) END"
_columns("dat2_listing_date", "date_texts", "id", day=(lambda: num.listing_date(c("text")), f"coalesce({_iso}, " + ", ".join(f"CASE WHEN regexp_matches({_n}, '{p}') THEN {tw.day(_x(p, y), _x(p, m) if m else chr(39) + '1' + chr(39), _x(p, d) if d else chr(39) + '1' + chr(39))} END" for p, y, m, d in _shapes) + ")"))
_sd = "^(\\d{1,2})\\.(\\d{1,2})\\.(\\d+)$"
_sx = lambda g: f"regexp_extract(regexp_replace(trim(text), '\\.+$', ''), '^ *(\\d+) *\\. *(\\d+) *\\. *(\\d+) *$', {g})"
_sy = f"(CASE WHEN TRY_CAST({_sx(3)} AS INT) < 100 THEN TRY_CAST({_sx(3)} AS INT) + 2000 ELSE TRY_CAST({_sx(3)} AS INT) END)"
_columns("dat3_sheet_date", "date_texts", "id", day=(lambda: num.sheet_date(c("text")), f"CASE WHEN {_sy} BETWEEN 2000 AND 2035 THEN {tw.day(f'CAST({_sy} AS VARCHAR)', _sx(2), _sx(1))} END"))
_stem = "regexp_replace(file_name, '\\.[^.]*$', '')"


def _tried(p: str, y: int, m: int, d: int, head: str = "") -> str:
    g = lambda i: f"regexp_extract({_stem}, '{p}', {i})"
    year = f"'{head}' || {g(y)}" if head else g(y) if y else "CAST(folder_year AS VARCHAR)"
    dom = g(d) if d else "'01'"
    return f"CASE WHEN regexp_matches({_stem}, '{p}') AND TRY_CAST({year} AS INT) BETWEEN 2013 AND 2030 THEN {tw.day(f'({year})', g(m), dom)} END"


_columns("dat4_file_date", "date_texts", "id", day=(lambda: num.file_date(c("file_name"), c("folder_year")), "coalesce(" + ", ".join(_tried(*t) for t in [
    ("(\\d{1,2})\\.(\\d{1,2})\\.(\\d{4})", 3, 2, 1), ("(\\d{4})\\D+?(\\d{1,2})\\.(\\d{1,2})(\\D|$)", 1, 3, 2), ("(^|\\D)(\\d{4})(\\d{2})(\\d{2})(\\D|$)", 2, 3, 4),
    ("(\\d{4})\\s(\\d{2})(\\d{2})(\\D|$)", 1, 2, 3), ("(\\d{4})\\s(\\d{2})(\\d{2})(\\D|$)", 1, 3, 2), ("(^|\\D)(\\d{4})_(\\d{2})(\\d{2})(\\D|$)", 2, 3, 4), ("(\\d{4})\\s(\\d{2})(\\D|$)", 1, 2, 0),
    ("(^|\\D)(\\d{4})-(\\d{2})-(\\d{2})(\\D|$)", 2, 3, 4), ("(^|\\D)(\\d{1,2})[._](\\d{1,2})[._](\\d{2})(\\D|$)", 4, 3, 2, "20"), ("(^|\\D)(\\d{2})(\\d{2})(\\d{4})(\\D|$)", 4, 3, 2), ("(^|\\D)(\\d{1,2})\\.(\\d{1,2})\\.", 0, 3, 2)]) + ")"))
_columns("dat6_period_months", "date_texts", "id", months=(lambda: num.period_months(c("period")), "CASE WHEN regexp_matches(period, '^\\d{4}$') THEN CAST(period AS INT) * 12 WHEN regexp_matches(period, '^\\d{4}-(0[1-9]|1[0-2])$') THEN CAST(left(period, 4) AS INT) * 12 + CAST(right(period, 2) AS INT) - 1 END"))
_columns("dat7_day_and_windows", "events", "event_id", day=(lambda: F.date_trunc("day", c("ts").cast("timestamp")).cast("date"), "CAST(date_trunc('day', ts) AS DATE)"), fresh=(lambda: (F.unix_timestamp(c("ts").cast("timestamp")) > 1704844800), "epoch(ts)::BIGINT > 1704844800"))


def udf2_folded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts without the marks of any letter, as digests."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(folding.unmarked_all(c("text"))).alias("folded"))


QUERIES["udf2_folded_documents"] = udf2_folded_documents
ORACLES["udf2_folded_documents"] = "SELECT doc_id, md5(replace(strip_accents(lower(text)), 'đ', 'd')) AS folded FROM documents"
