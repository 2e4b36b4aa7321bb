"""Worked examples: amounts, dates, texts and decisions that are known beforehand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from motorfisc.functions import categories as cat
from motorfisc.functions import numbers as num
from motorfisc.functions import text as txt
from motorfisc.functions.similarity import common_length, indel_ratio, token_set_ratio
from motorfisc.operators import articles, corpus, listings, match, price, sheets, tax, upsert

OFFER = "price_eur double, co2_g_km double, fuel_type string, first_registration_date date, declaration_date date, eaer_city_range_km double, seat_count int, is_camper boolean, is_new_vehicle boolean"
OLD = dict(price_eur=70318.61, co2_g_km=136.0, fuel_type="diesel", first_registration_date=dt.date(2020, 8, 17), declaration_date=dt.date(2025, 7, 10), eaer_city_range_km=None, seat_count=None, is_camper=False, is_new_vehicle=False)


def taxed(spark, **change):
    row = OLD | change
    names = [f.split()[0] for f in OFFER.split(", ")]
    return tax.tax_breakdown(spark.createDataFrame([tuple(row[n] for n in names)], OFFER)).first()


def column(spark, value, kind, make):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x"))).first()[0]


def test_decided_case(spark):
    r = taxed(spark)
    assert (r.months_old, r.depreciation_percent, r.as_new_value_component, r.as_new_eco_component, r.as_new_total, r.final_ppmv) == (58, 0.4156, 4973.43, 3389.18, 8362.61, 3475.50)


@pytest.mark.parametrize("change, factor", [({"eaer_city_range_km": 59.0}, 0.41), ({"eaer_city_range_km": 100.0}, 0.0), ({"eaer_city_range_km": 120.0}, 0.0), ({"seat_count": 8}, 0.5), ({"seat_count": 9}, 0.25), ({"seat_count": 7}, 1.0), ({"is_camper": True}, 0.15)])
def test_reductions(spark, change, factor):
    assert taxed(spark, **change).vehicle_reduction_factor == pytest.approx(factor)


def test_new_and_electric_and_rejected(spark):
    day = dt.date(2026, 1, 1)
    r = taxed(spark, price_eur=35000.0, co2_g_km=137.0, fuel_type="petrol", first_registration_date=day, declaration_date=day, is_new_vehicle=True)
    assert (r.depreciation_percent, r.final_ppmv, r.co2_standard_used) == (1.0, 1093.59, "WLTP")
    assert taxed(spark, fuel_type="electric", co2_g_km=0.0).final_ppmv == 0
    assert [taxed(spark, **c).status for c in ({"price_eur": 0.0}, {"co2_g_km": 0.0}, {"declaration_date": dt.date(2019, 1, 1)}, {"price_eur": None})] == ["price_not_positive", "zero_co2_not_electric", "declared_before_registration", "missing_input"]


def test_tax_grows_with_emission_within_a_bracket(spark):
    sums = [taxed(spark, co2_g_km=float(x)).as_new_eco_component for x in range(60, 260, 10)]
    assert sums == sorted(sums)


@pytest.mark.parametrize("a, b, n", [("2020-08-17", "2025-07-10", 58), ("2021-01-31", "2021-02-28", 1), ("2021-01-31", "2021-02-27", 0), ("2021-05-05", "2021-05-05", 0), ("2024-01-31", "2024-02-29", 1), ("2024-01-31", "2024-02-28", 0)])
def test_months(spark, a, b, n):
    assert spark.range(1).select(tax.completed_months(F.lit(a).cast("date"), F.lit(b).cast("date"))).first()[0] == n


@pytest.mark.parametrize("months, share", [(180, 0.1932), (191, 0.1932), (192, 0.1872), (360, 0.1032), (400, 0.1032), (1000, 0.1032)])
def test_old_age(spark, months, share):
    df = spark.createDataFrame([(months, False)], "months_old int, is_new_vehicle boolean")
    assert float(tax.with_depreciation(df).first().depreciation_percent) == share


@pytest.mark.parametrize("text, x", [("12.500,00", 12500), ("12,500.00", 12500), ("1,234.56", 1234.56), ("18.500", 18500), ("132,0", 132), ("79,530", 79530), ("", None), ("n/a", None), ("1.234.567", None)])
def test_numbers(spark, text, x):
    assert column(spark, text, "string", num.display_number) == x


@pytest.mark.parametrize("name, day", [("BMW,MINI 11.01.2024..xlsx", "2024-01-11"), ("VOLVO 2013 11.11..xlsx", "2013-11-11"), ("Dacia 20130701.xls", "2013-07-01"), ("BMW 2020 0102.xlsx", "2020-01-02"), ("Renault 2014 1408.xls", "2014-08-14"), ("toyota2015_0921.xlsx", "2015-09-21"), ("Dacia - 2014 01.xls", "2014-01-01"), ("HONDA CJENIK 60015 - 01.07..xls", None), ("Brand 2012 0101.xlsx", None), ("Brand 20130132.xlsx", None), ("Brand 20131301.xlsx", None)])
def test_file_dates(spark, name, day):
    got = column(spark, name, "string", lambda x: num.file_date(x, F.lit(None).cast("int")))
    assert (str(got) if got else None) == day


@pytest.mark.parametrize("text, day", [("2021-05-17T00:00:00.000Z", "2021-05-17"), ("17. 05. 2021.", "2021-05-17"), ("7.5.2021", "2021-05-07"), ("17/05/2021", "2021-05-17"), ("05.2021", "2021-05-01"), ("05/2021", "2021-05-01"), ("2021-05", "2021-05-01"), ("2021", "2021-01-01"), ("soon", None), ("31.02.2021", None)])
def test_listing_dates(spark, text, day):
    got = column(spark, text, "string", num.listing_date)
    assert (str(got) if got else None) == day


@pytest.mark.parametrize("text, norm", [("Škoda Octavia", "skoda octavia"), ("40TDI", "40 tdi"), ("320d", "320d"), ("xDrive20d", "xdrive 20d"), ("BMW_X6_xDrive40i_SAV", "bmw x6 xdrive 40i sav"), ("A4 Avant S tr", "a4 wagon s tronic"), (None, "")])
def test_normalized(spark, text, norm):
    assert column(spark, text, "string", txt.normalized) == norm
    assert column(spark, norm, "string", txt.normalized) == norm


@pytest.mark.parametrize("text, brand, fuel", [("A4 40 TDI", None, "diesel"), ("320d", None, "diesel"), ("120i", None, "petrol"), ("1.4 D-CVVT", None, None), ("1.6 i-DTEC", None, None), ("2.0i", None, "petrol"), ("G120", "Mazda", "petrol"), ("CD175", "mazda", "diesel"), ("G20", "BMW", None), ("SKYACTIV-D 150", None, "diesel"), ("TDI TSI", None, None)])
def test_fuel_of_text(spark, text, brand, fuel):
    assert column(spark, text, "string", lambda x: cat.fuel_family(x, F.lit(brand))) == fuel


def test_similarity(spark):
    for a, b in (("karokq", "karoq"), ("abc", ""), ("abcbdab", "bdcaba"), ("a" * 90 + "b", "b" + "a" * 90)):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_length(a, b) == table[-1][-1]
    ratio = lambda f, a, b: spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b"))).first()[0]
    assert round(ratio(indel_ratio, "karokq", "karoq")) == 91
    assert ratio(token_set_ratio, "a3", "q3") == 50 and ratio(token_set_ratio, "120i", "520i") == 75
    assert ratio(token_set_ratio, "bmw 320d", "bmw serija 3 320d touring") == 100 and ratio(token_set_ratio, "", "x") == 0


CATALOGUE = "catalogue_id long, brand string, model string, variant string, match_key string, price_eur double, co2_g_km double, fuel_type string, power_kw double, valid_from date"
LISTING = "listing_id long, brand string, model string, variant string, fuel_type string, power_kw double, co2_g_km double, year int"


def matched(spark, rows, *listing):
    rows = [(i, "BMW", m, v, None, p, 110.0, f, kw, d) for i, (m, v, p, f, kw, d) in enumerate(rows)]
    df = spark.createDataFrame(rows, CATALOGUE).withColumn("match_key", txt.match_key(F.col("brand"), F.col("model"), F.col("variant")))
    return match.match_listings(spark.createDataFrame([(1, "bmw", *listing)], LISTING), df).first()


D19, D21 = dt.date(2019, 1, 1), dt.date(2021, 1, 1)


def test_match_decisions(spark):
    sure = matched(spark, [("320d", "320d xDrive", 50000.0, "diesel", 140.0, D19), ("320i", "320i", 45000.0, "petrol", 135.0, D19)], "320d", "320d xDrive", None, 140.0, None, 2019)
    assert (sure.status, sure.matched_id) == ("auto_matched", 0) and all(x.catalogue_id != 1 for x in sure.candidates)
    tie = matched(spark, [("320d", "320d M Sport", 50000.0, "diesel", 140.0, D19), ("320d", "320d Luxury", 52000.0, "diesel", 140.0, D19)], "320d", None, None, 140.0, None, 2019)
    assert tie.status == "candidates" and tie.matched_id is None and len(tie.candidates) == 2
    periods = [("320d", "320d", 50000.0, "diesel", 140.0, D19), ("320d", "320d", 50000.0, "diesel", 140.0, D21)]
    assert [matched(spark, periods, "320d", None, None, 140.0, None, y).matched_id for y in (2018, 2019, 2020, 2022, None)] == [0, 0, 0, 1, 1]
    other = matched(spark, [("120i", "120i", 30000.0, "petrol", 125.0, D19)], "520i", None, None, 185.0, None, 2019)
    assert other.status == "no_match" and other.candidates == []
    noise = matched(spark, [("Serija 3 (F30)", "320d", 50000.0, "diesel", 140.0, D19)], "320d", "Advantage Steptronic", None, 140.0, None, 2019)
    assert noise.status == "auto_matched"
    assert matched(spark, [("320d", "320d", 1.0, "diesel", 140.0, D19)], "320d", None, None, None, None, None).status in ("auto_matched", "candidates")


def test_wrong_engine_is_kept_from_a_sure_match(spark):
    assert matched(spark, [("120", "120", 30000.0, "petrol", 95.0, D19)], "120", None, None, 131.0, None, 2019).status != "auto_matched"


ENGINE = "engine_id long, brand string, title string, engine_code string, production_start string, production_end string, displacement_cc double, power_kw double, fuel_type string, co2_min double, co2_max double, source_url string, brand_check string, source_order_corrected boolean"


def answer(spark, *ranges, title=("BMW F30", "BMW F30")):
    rows = [(i, "BMW", title[i], code, "2012", "2022-12", 1995.0, 140.0, "diesel", lo, hi, "u", "confirmed", False) for i, (code, lo, hi) in enumerate(ranges)]
    vehicles = spark.createDataFrame([(1, "BMW", "320d", "Diesel", 140.0, None, dt.date(2021, 6, 1))], "vehicle_id long, brand string, v_model string, v_fuel string, v_power double, v_cc double, registered date")
    return corpus.co2_range(vehicles, spark.createDataFrame(rows, ENGINE)).first()


def test_emission_ranges(spark):
    one = answer(spark, ("320d", 105.0, 107.0), ("320d xDrive", 114.0, 117.0))
    assert (one.co2_min, one.co2_max, one.merged_rows) == (105, 107, 1)
    two = answer(spark, ("320d", 105.0, 107.0), ("320d", 115.0, 122.0))
    assert (two.co2_min, two.co2_max, two.merged_rows) == (105, 122, 2)
    assert answer(spark, ("320d", 105.0, 107.0), ("320d", 115.0, 122.0), title=("BMW F30", "BMW E90")) is None


def test_sheet_with_subheader_currency_and_late_header(spark):
    grid = [["Cjenik"], ["MODEL", "NAZIV", "Price", "CO2", "VRIJEDI OD"], ["", "", "cijena KN", "", ""], ["Astra", "1.6 dizel", "75345", "120*", "01.02.2023."], ["Corsa", "1.2 benzin", "-1", "110", "01.02.2023."], ["Zafira", "2.0 dizel", "x", "1", "01.02.2023."]]
    cells = [("f.xls", "s", r, k, v, "num" if v.lstrip("-").isdigit() else "str") for r, row in enumerate(grid) for k, v in enumerate(row)]
    df = spark.createDataFrame(cells, "file string, sheet string, row_idx int, col_idx int, value string, kind string")
    assert sheets.header_rows(df).first().header_row == 1
    fields = {"model_name": "MODEL", "full_name": "NAZIV", "price": "price", "co2": "CO2", "valid_from": "VRIJEDI OD."}
    mapping = spark.createDataFrame([("ok", "EUR", 0.9, fields)], "status string, price_currency string, confidence double, fields map<string,string>").withColumn("fingerprint", txt.header_fingerprint(F.array(*[F.lit(h) for h in grid[1]])))
    rows = sheets.canonical_rows(df, mapping, spark.createDataFrame([("f.xls", None)], "file string, default_valid_from date")).orderBy("source_row").collect()
    assert [r.skip_reason for r in rows] == ["junk_row", None, "nonpositive_price", "missing_price"]
    assert (rows[1].price_eur, rows[1].currency, rows[1].co2_g_km, rows[1].source_row, rows[1].needs_review) == (10000.0, "HRK", 120.0, 3, True)
    assert sheets.canonical_rows(df, mapping.withColumn("confidence", F.lit(0.5)), spark.createDataFrame([], "file string, default_valid_from date")).collect() == []


def test_estimates_tell_the_best_rows_also_without_a_range(spark):
    rows = [(1, "BMW", "BMW F30", "320d", "2012", "2022-12", 1995.0, 140.0, "diesel", 100.0, 120.0, "u1", "confirmed", False), (2, "BMW", "BMW F30", "320d", "2012", "2022-12", 1995.0, 140.0, "diesel", 105.0, 107.0, "u2", "confirmed", True), (3, "BMW", "BMW E90", "320d", "2012", "2022-12", 1995.0, 140.0, "diesel", 105.0, 106.0, None, "confirmed", False)]
    vehicles = spark.createDataFrame([(1, "BMW", "320d", "Diesel", 140.0, None, dt.date(2021, 6, 1))], "vehicle_id long, brand string, v_model string, v_fuel string, v_power double, v_cc double, registered date")
    sure = corpus.co2_estimates(vehicles, spark.createDataFrame(rows[:2], ENGINE)).first()
    # the narrower of two equal rows speaks for both
    assert (sure.co2_min, sure.co2_max, sure.source_url, sure.source_urls, sure.engine_code, sure.merged_rows, sure.source_order_corrected) == (100, 120, "u2", ["u2", "u1"], "320d", 2, True)
    unsure = corpus.co2_estimates(vehicles, spark.createDataFrame(rows, ENGINE)).first()
    assert (unsure.co2_min, unsure.title, unsure.source_urls) == (None, None, None) and [x.engine_id for x in unsure.candidates] == [3, 2, 1]


def test_bands_of_power_lose_no_pair(spark):
    engines = spark.createDataFrame([(i, "BMW", "BMW F30", "320d", "2012", "2022-12", None, None if i == 0 else i * 7.5, "diesel", 100.0, 101.0, "u", "confirmed", False) for i in range(40)], ENGINE).withColumn("_brand", F.lower("brand"))
    vehicles = spark.createDataFrame([(i, "bmw", None if i == 0 else i * 6.25) for i in range(50)], "vehicle_id long, _brand string, v_power double")
    got = {(r.vehicle_id, r.engine_id) for r in corpus._brand_pairs(vehicles, engines).collect()}
    want = {(v, e) for v in range(50) for e in range(40) if v == 0 or e == 0 or abs(v * 6.25 - e * 7.5) <= 25}
    assert want <= got and len(got) < 50 * 40 and len(corpus._brand_pairs(vehicles, engines).collect()) == len(got)


def test_a_title_loses_any_spelling_of_its_brand(spark):
    rows = [("VW Golf VII", "1.6 TDI", "Volkswagen"), ("Mercedes-Benz Baureihe 205", "C 220 d", "Mercedes-Benz"), ("Golf", None, "Volkswagen"), (None, "320d", "BMW"), ("VW", None, "Volkswagen")]
    got = spark.createDataFrame(rows, "t string, e string, b string").select(corpus.haystack(F.col("t"), F.col("e"), F.col("b"))).collect()
    assert [r[0] for r in got] == ["golf vii 1 6 tdi", "baureihe 205 c 220 d", "golf", "320d", ""]


def test_an_article_outranks_the_date(spark):
    rows = [(1, "BMW", "BMW F30", "320d", "2012", "2018"), (2, "BMW", "BMW G20", "320d", "2019", "2022")]
    engines = spark.createDataFrame(rows, "engine_id long, brand string, title string, engine_code string, production_start string, production_end string").withColumn("power_kw", F.lit(140.0))
    q = lambda article: spark.createDataFrame([(1, "BMW", "320d", dt.date(2021, 6, 1), article)], "query_id long, brand string, q_text string, registered date, article string")
    assert [[r.engine_id for r in corpus.browse_engines(q(a), engines).collect()] for a in (None, "BMW F30", "BMW G20", "x")] == [[2], [1], [2], []]


def test_nested_tables_are_parts_of_the_outer_one(spark):
    text = "lead\n== Motoren ==\n{| a\n| x {| b\n| y\n|} z\n|}\nmid {| c\n|}\n== Technik ==\n{| never closed"
    got = articles.tables(spark.createDataFrame([("t", text)], "title string, wikitext string")).orderBy("at").collect()
    assert [(r.heading_path, r.table) for r in got] == [(["Motoren"], "{| a\n| x {| b\n| y\n|} z\n|}"), (["Motoren"], "{| c\n|}")]


def test_articles_without_links_are_escalated(spark):
    df = spark.createDataFrame([("a", "== Modelle ==\n" + " ".join(f"[[Opel {i}]]" for i in range(5))), ("b", "== Modelle ==\nnone"), ("c", "no section"), ("d", None)], "title string, wikitext string")
    assert sorted(tuple(r) for r in articles.crawl_report(df).collect()) == [("a", 5, False), ("b", 0, True), ("c", 0, True), ("d", 0, True)]


def test_null_keys_are_written(spark):
    schema = "a long, b long, price double"
    old, new = spark.createDataFrame([(None, 1, 1.0), (2, 2, 2.0)], schema), spark.createDataFrame([(None, 1, 9.0), (None, 7, 7.0)], schema)
    got = upsert.upserted(old, new, ["a", "b"], [], [F.desc("price")]).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(2, 2, 2.0), (None, 1, 9.0), (None, 7, 7.0)], key=str)


@pytest.mark.parametrize(("fuel", "status"), [("petrol", "ok"), ("diesel", "ok"), ("electric", "electric_with_co2"), ("benzin", "unknown_fuel"), ("lpg", "unknown_fuel"), ("hydrogen", "unknown_fuel")])
def test_the_tax_knows_three_fuels(spark, fuel, status):
    schema = "price_eur double, co2_g_km double, fuel_type string, first_registration_date date, declaration_date date, eaer_city_range_km double, seat_count int, is_camper boolean, is_new_vehicle boolean"
    offer = spark.createDataFrame([(40000.0, 180.0, fuel, dt.date(2022, 1, 1), dt.date(2025, 1, 1), None, None, False, False)], schema)
    assert tax.tax_breakdown(offer).first().status == status


def test_a_listings_fuel_is_read_in_all_spellings(spark):
    spelt = ["LPG ", "cng", "hybrid", "Electric", "elektrisch", "elektro", "Benzin", "gasoline", "petrol", "dizel", "diesel", "hydrogen", None]
    got = spark.createDataFrame([(s,) for s in spelt], "s string").select(cat.tax_fuel(F.col("s"))).collect()
    assert [r[0] for r in got] == ["petrol"] * 3 + ["electric"] * 3 + ["petrol"] * 3 + ["diesel"] * 2 + [None] * 2
    rows = [(0, "BMW", "320d", "320d", None, 50000.0, 110.0, "diesel", 140.0, D19)]
    catalogue = spark.createDataFrame(rows, CATALOGUE).withColumn("match_key", txt.match_key(F.col("brand"), F.col("model"), F.col("variant")))
    listed = [(1, "hydrogen"), (2, None), (3, "LPG"), (4, " ")]
    asked = spark.createDataFrame([(i, "BMW", "320d", None, f, 140.0, 110.0, 2019, 20000.0, D19) for i, f in listed], LISTING + ", price_eur double, valid_from date")
    priced = {r.listing_id: (r.status, r.fuel_type) for r in price.price_listings(asked, catalogue, spark.createDataFrame([], ENGINE), "2025-07-10").collect()}
    assert priced[1] == ("needs_fuel", None) and priced[3] == ("ok", "petrol") and priced[2][1] == priced[4][1] == "diesel"


def test_a_page_tells_its_emissions_and_number(spark):
    html = "<table><tr><td>CO2 emisija:</td><td>132,5 g/km</td></tr><tr><td>Broj sasije</td><td>WVWZZZ1KZAW000001</td></tr><tr><td>Brand</td><td>VW</td></tr></table>"
    row = listings.page_listings(spark.createDataFrame([(1, "https://www.njuskalo.hr/auti/x-1", html)], "page_id long, url string, html string")).first()
    assert (row.co2_g_km, row.vin, row.brand) == (132.5, "WVWZZZ1KZAW000001", "VW")
