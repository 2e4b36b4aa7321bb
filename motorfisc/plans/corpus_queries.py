"""Engine corpus queries over ``part`` and ``supplier``, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorfisc.functions import dims
from motorfisc.functions import text as txt
from motorfisc.operators import articles as art
from motorfisc.operators import backtest, brands, corpus, load, price
from motorfisc.plans import twins as tw
from motorfisc.plans.derived import SQL, derive, duck
from motorfisc.plans.table_queries import catalogue, listings
from motorfisc.session import checkpoint_folder, settled
from motorfisc.sources import readers, versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_E = f"e AS ({duck(SQL['engines'])})"
_V = f"v AS ({duck(SQL['vehicles'])})"
_M = lambda x: f"CASE WHEN regexp_matches({x}, '^\\d{{4}}$') THEN CAST({x} AS INT) * 12 WHEN regexp_matches({x}, '^\\d{{4}}-(0[1-9]|1[0-2])$') THEN CAST(left({x}, 4) AS INT) * 12 + CAST(right({x}, 2) AS INT) - 1 END"
_FIXED = "o AS (SELECT * REPLACE (CASE WHEN co2_min > co2_max THEN co2_max ELSE co2_min END AS co2_min, CASE WHEN co2_min > co2_max THEN co2_min ELSE co2_max END AS co2_max), coalesce(co2_min > co2_max, false) AS source_order_corrected FROM e)"
_ERRORS = f"list_filter([CASE WHEN NOT co2_min BETWEEN 0 AND 500 THEN 'co2_min_implausible' END, CASE WHEN NOT co2_max BETWEEN 0 AND 500 THEN 'co2_max_implausible' END, CASE WHEN co2_min > co2_max THEN 'co2_order' END, CASE WHEN power_kw <= 0 THEN 'power_not_positive' END, CASE WHEN power_kw > 1500 THEN 'power_implausible' END, CASE WHEN NOT displacement_cc BETWEEN 200 AND 9000 THEN 'displacement_implausible' END, CASE WHEN production_start <> '' AND ({_M('production_start')}) IS NULL THEN 'start_unreadable' END, CASE WHEN production_end <> '' AND ({_M('production_end')}) IS NULL THEN 'end_unreadable' END, CASE WHEN ({_M('production_start')}) > ({_M('production_end')}) THEN 'period_order' END], lambda x: x IS NOT NULL)"
_REVIEW = f"CASE WHEN len({_ERRORS}) > 0 THEN 'validation' WHEN brand_check = 'unverified' THEN 'unverified' WHEN source_order_corrected AND co2_max - co2_min > 40 THEN 'implausible_correction' END"


@_query(f"WITH {_E} SELECT engine_id, array_to_string({_ERRORS}, ',') AS errors FROM e")
def flt16_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules that each engine variant breaks."""
    engines = derive(spark, sf_dir, "engines")
    return engines.select("engine_id", F.array_join(corpus.validation_errors(engines), ",").alias("errors"))


@_query(f"WITH {_E}, {_FIXED} SELECT engine_id, co2_min, co2_max, source_order_corrected, coalesce(co2_min, co2_max) AS low, coalesce(co2_max, co2_min) AS high FROM o")
def num16_num17_ordered_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emission figures in order, and a one-sided row's own range."""
    return corpus.ordered_range(derive(spark, sf_dir, "engines")).select("engine_id", "co2_min", "co2_max", "source_order_corrected", F.coalesce("co2_min", "co2_max").alias("low"), F.coalesce("co2_max", "co2_min").alias("high"))


@_query(f"WITH {_E}, {_FIXED} SELECT engine_id, source_fingerprint, variant_index, {_REVIEW} AS review_reason FROM o QUALIFY row_number() OVER (PARTITION BY source_fingerprint, variant_index ORDER BY engine_id DESC) = 1")
def job9_flt17_load_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine rows by key with their review reason."""
    return corpus.load_engines(derive(spark, sf_dir, "engines")).select("engine_id", "source_fingerprint", "variant_index", "review_reason")


#: What the titles of crawled variants say of their brand, and the rows of a load with their reasons, one for each key.
_FILED = {"BMW 3er F30": "BMW", "BMW i3": "BMW", "Opel Astra G": "Opel", "VW Golf VII": "Volkswagen"}
_CHECKED = f"(SELECT *, CASE WHEN marque IS NULL THEN 'unverified' WHEN marque = crawl_brand THEN 'confirmed' ELSE 'refiled' END AS brand_check, coalesce(marque, crawl_brand) AS brand FROM (SELECT *, {tw.case('title', _FILED, 'NULL')} AS marque FROM {{}}) t)"
_LOADED = f"SELECT *, {_REVIEW} AS reason FROM {{}} QUALIFY row_number() OVER (PARTITION BY source_fingerprint, variant_index ORDER BY engine_id DESC) = 1"


_DIESEL = "(SELECT * REPLACE (co2_min + 50 AS co2_min) FROM w WHERE fuel_type = 'diesel') s"
_LOADS = f"w AS ({duck(SQL['crawled'])}), e AS (SELECT * FROM {_CHECKED.replace('{}', 'w')}), {_FIXED}, a AS ({_LOADED.replace('{}', 'o')}), e2 AS (SELECT * FROM {_CHECKED.replace('{}', _DIESEL)}), {_FIXED.replace('o AS', 'o2 AS').replace('FROM e)', 'FROM e2)')}, b AS ({_LOADED.replace('{}', 'o2')})"


@_query(f"WITH {_LOADS}, u AS (SELECT * FROM b UNION ALL BY NAME SELECT a.* FROM a LEFT JOIN b ON a.source_fingerprint = b.source_fingerprint AND a.variant_index = b.variant_index WHERE b.engine_id IS NULL) SELECT source_fingerprint, variant_index, engine_id, brand, brand_check, co2_min, co2_max, source_order_corrected FROM u WHERE reason IS NULL")
def job9_snk4_committed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine table after a load of all variants and one of the diesels with other figures: checked, put in, pruned."""
    path = f"{checkpoint_folder(spark)}/engines-{uuid4().hex}"
    crawled = derive(spark, sf_dir, "crawled")
    load.load(spark, path, crawled, "crawl", 0)
    load.load(spark, path, crawled.where("fuel_type = 'diesel'").withColumn("co2_min", c("co2_min") + 50), "crawl", 1)
    return versions.read(spark, path).select("source_fingerprint", "variant_index", "engine_id", "brand", "brand_check", "co2_min", "co2_max", "source_order_corrected")


@_query(f"WITH {_E}, {_FIXED}, r AS (SELECT *, {_REVIEW} AS reason FROM o QUALIFY row_number() OVER (PARTITION BY source_fingerprint, variant_index ORDER BY engine_id DESC) = 1) SELECT brand, reason, count(*) AS n, count(*) FILTER (WHERE source_order_corrected) AS corrected FROM r GROUP BY ALL")
def agg11_upsert_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loaded and reviewed rows by brand and reason."""
    loaded = corpus.load_engines(derive(spark, sf_dir, "engines"))
    return loaded.groupBy("brand", c("review_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if("source_order_corrected").alias("corrected"))


@_query(f"WITH {_E} SELECT engine_id, brand FROM e WHERE brand = 'BMW' AND brand_check <> 'unverified' AND (co2_min IS NOT NULL OR co2_max IS NOT NULL)")
def src5_corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable rows of a brand."""
    return corpus.eligible(derive(spark, sf_dir, "engines")).where("brand = 'BMW'").select("engine_id", "brand")


_REG = "(year(registered) * 12 + month(registered) - 1)"
_DROP = f"CASE WHEN brand_check = 'unverified' THEN 'brand_unverified' WHEN co2_min IS NULL AND co2_max IS NULL THEN 'no_co2' WHEN {tw.case('lower(trim(v_fuel))', dims.CORPUS_FUEL, 'NULL')} <> fuel_type THEN 'fuel_mismatch' WHEN abs(v_power - power_kw) > 25 THEN 'power_gap' WHEN registered IS NOT NULL AND ({_M('production_start')}) IS NULL AND ({_M('production_end')}) IS NULL THEN 'no_production_period' WHEN {_REG} < ({_M('production_start')}) - 3 THEN 'registered_before_production' WHEN {_REG} > ({_M('production_end')}) + 18 THEN 'registered_after_production' END"


@_query(f"WITH {_E}, {_V} SELECT vehicle_id, {_DROP} AS reason, count(*) AS n FROM v JOIN e USING (brand) GROUP BY ALL")
def flt8_jn7_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine rows of each vehicle's brand by why they can't be its own."""
    return corpus.drop_counts(derive(spark, sf_dir, "vehicles"), derive(spark, sf_dir, "engines"))


_TITLE = tw.tokens(tw.corpus_text("title"))
_SPELT = f"list_transform({tw.quoted(brands.spellings())}, lambda s: {tw.corpus_text('s')})"
_TAKEN = f"coalesce(list_max(list_filter([1, 2, 3, 4], lambda n: list_contains({_SPELT}, array_to_string(({_TITLE})[1:n], ' ')))), 0)"
_HAY = tw.joined(f"list_filter(list_concat(({_TITLE})[{_TAKEN} + 1:], {tw.tokens(tw.corpus_text('engine_code'))}), lambda t: NOT list_contains({tw.tokens(tw.corpus_text('brand'))}, t))")


@_query(f"WITH {_E} SELECT engine_id, {_HAY} AS hay FROM e")
def str15_haystack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each row's title and code say beside the brand."""
    return derive(spark, sf_dir, "engines").select("engine_id", corpus.haystack(c("title"), c("engine_code"), c("brand")).alias("hay"))


_SCOPED = f"p AS (SELECT vehicle_id AS query_id, engine_id, NOT (coalesce({_REG} < ({_M('production_start')}) - 6, false) OR coalesce({_REG} > ({_M('production_end')}) + 24, false)) AS inside FROM v JOIN e USING (brand))"


#: What decides whether a vehicle is shown a row, and the row's key.
_SHOWN = ["engine_id", "brand", "title", "production_start", "production_end"]
_CHOSEN = "a AS (SELECT vehicle_id AS query_id, CASE WHEN vehicle_id % 2 = 0 THEN (SELECT min(title) FROM e WHERE e.brand = v.brand) END AS article FROM v), t AS (SELECT p.*, title, article FROM p JOIN e USING (engine_id) JOIN a USING (query_id)), s AS (SELECT * FROM t QUALIFY inside OR NOT bool_or(inside) OVER (PARTITION BY query_id)), i AS (SELECT * FROM s WHERE article IS NULL OR title = article)"


@_query(f"WITH {_E}, {_V}, {_SCOPED}, {_CHOSEN} SELECT query_id, engine_id FROM i UNION ALL SELECT query_id, engine_id FROM t WHERE title = article AND query_id NOT IN (SELECT query_id FROM i)")
def flt20_exact_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in scope of a vehicle, those of the article alone where half of the vehicles name one."""
    engines = derive(spark, sf_dir, "engines").select(*_SHOWN)
    firsts = engines.groupBy("brand").agg(F.min("title").alias("article"))
    v = derive(spark, sf_dir, "vehicles").withColumnRenamed("vehicle_id", "query_id").join(firsts, "brand", "left").withColumn("article", F.when(c("query_id") % 2 == 0, c("article")))
    return corpus.shown_rows(v.select("query_id", "brand", "registered", "article"), engines).select("query_id", "engine_id")


@_query(f"WITH {_E}, {_V}, {_SCOPED} SELECT query_id, engine_id FROM p QUALIFY inside OR NOT bool_or(inside) OVER (PARTITION BY query_id)")
def flt9_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows built around a vehicle's registration, or all of its brand."""
    v = derive(spark, sf_dir, "vehicles").select(c("vehicle_id").alias("query_id"), "brand", "registered")
    return corpus.shown_rows(v, derive(spark, sf_dir, "engines").select(*_SHOWN)).select("query_id", "engine_id")


@_query()
def job10_win7_co2_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emission range, or none, and the best rows of each vehicle."""
    found = corpus.co2_estimates(derive(spark, sf_dir, "vehicles"), corpus.ordered_range(derive(spark, sf_dir, "engines")))
    return found.withColumn("source_urls", F.array_join("source_urls", " ")).withColumn("candidates", F.to_json("candidates"))


@_query()
def job10_co2_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emission range of each vehicle that the corpus is sure of."""
    return corpus.co2_range(derive(spark, sf_dir, "vehicles"), corpus.ordered_range(derive(spark, sf_dir, "engines")))


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = derive(spark, sf_dir, "vehicles")
    typo = F.when(c("vehicle_id") % 10 == 7, F.regexp_replace("v_model", "Corolla", "Corola")).otherwise(c("v_model"))
    return v.select(c("vehicle_id").alias("query_id"), "brand", txt.corpus_text(typo).alias("q_text"), "registered")


@_query()
def job11_browse_engines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each search shows."""
    return corpus.browse_engines(_searches(spark, sf_dir), corpus.eligible(derive(spark, sf_dir, "engines"))).withColumn("honoured", F.array_join("honoured", " "))


@_query()
def set6_ignored_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each search that no row shown meets."""
    q = _searches(spark, sf_dir)
    return corpus.ignored_terms(q, corpus.browse_engines(q, corpus.eligible(derive(spark, sf_dir, "engines")))).withColumn("ignored", F.array_join("ignored", " "))


@_query()
def job12_browse_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of each search's brand, those that meet it first."""
    return corpus.browse_models(_searches(spark, sf_dir), corpus.eligible(derive(spark, sf_dir, "engines"))).withColumn("sample_codes", F.array_join("sample_codes", "|"))


_READ = lambda x: f"coalesce({_M(x)}, 0)"


@_query(f"WITH {_E}, u AS (SELECT *, {_READ('production_start')} AS s, {_READ('production_end')} AS t, max({_READ('production_start')}) OVER (PARTITION BY brand, title) AS newest FROM e WHERE brand_check <> 'unverified' AND (co2_min IS NOT NULL OR co2_max IS NOT NULL)), k AS (SELECT DISTINCT brand, title, trim(engine_code) AS code FROM u WHERE trim(engine_code) <> ''), n AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY brand, title ORDER BY length(code), code) <= {corpus.SAMPLE_CODES}), m AS (SELECT brand, title, array_to_string(list_sort(list(code)), '|') AS sample_codes FROM n GROUP BY ALL), g AS (SELECT brand, title, count(*) AS variant_count, min({{'s': s, 'x': production_start}}) FILTER (WHERE production_start <> '') AS a, max({{'t': t, 'x': production_end}}) FILTER (WHERE production_end <> '') AS z, bool_or(production_end IS NULL AND s = newest) AS is_open, least(min(co2_min), min(co2_max)) AS co2_min, greatest(max(co2_min), max(co2_max)) AS co2_max FROM u GROUP BY ALL) SELECT brand, title, variant_count, a.x AS production_start, CASE WHEN NOT is_open THEN z.x END AS production_end, co2_min, co2_max, sample_codes FROM g LEFT JOIN m USING (brand, title)")
def agg8_srt3_model_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article of the corpus: rows, period, sample codes and emissions."""
    groups = corpus.model_groups(corpus.eligible(derive(spark, sf_dir, "engines")), ["brand", "title"])
    return groups.select("brand", "title", "variant_count", "production_start", "production_end", "co2_min", "co2_max", F.array_join("sample_codes", "|").alias("sample_codes"))


_SPOT = 50


@_query(f"WITH {_E}, r AS (SELECT engine_id, brand, CASE WHEN engine_id % 9 = 0 THEN 'normal' WHEN engine_id % 31 = 0 THEN 'unclear' ELSE 'transposed' END AS orientation FROM e), b AS (SELECT *, row_number() OVER (PARTITION BY orientation, brand ORDER BY md5(CAST(engine_id AS VARCHAR)), engine_id) AS t, count(*) OVER (PARTITION BY orientation, brand) AS of_brand, count(*) OVER (PARTITION BY orientation) AS n FROM r), d AS (SELECT *, row_number() OVER (PARTITION BY orientation ORDER BY t, of_brand DESC, brand) AS turn FROM b), q AS (SELECT DISTINCT orientation, least(n, 10) AS quota FROM b WHERE orientation <> 'transposed'), w AS (SELECT * FROM q UNION ALL SELECT 'transposed', {_SPOT} - (SELECT sum(quota) FROM q)) SELECT orientation, brand, engine_id, turn FROM d JOIN w USING (orientation) WHERE turn <= quota")
def job16_win10_spot_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty tables to check by hand, two fifths of them kept for the rarer orientations."""
    kind = F.when(c("engine_id") % 9 == 0, "normal").when(c("engine_id") % 31 == 0, "unclear").otherwise("transposed")
    results = derive(spark, sf_dir, "engines").select(kind.alias("orientation"), "brand", "engine_id", F.md5(c("engine_id").cast("string")).alias("h"))
    return art.spot_check_sample(results, _SPOT, F.struct("h", "engine_id")).select("orientation", "brand", "engine_id", "turn")


@_query(f"WITH {_E} SELECT brand AS crawl_brand, title AS model_article_title, source_url, 'phase2_5_tripwire' AS reason, 'table returned no CO2 but its wikitext contains CO2-shaped text: ' || CAST(engine_id AS VARCHAR) || ' g/km, g/km' AS error FROM e WHERE brand IN ('BMW', 'Mazda') AND co2_min IS NULL AND co2_max IS NULL")
def src8_tripwires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows of two brands out of the reports of all tables without emissions."""
    found = F.array(F.concat(c("engine_id").cast("string"), F.lit(" g/km")), F.lit("g/km"))
    tables = derive(spark, sf_dir, "engines").where("co2_min is null and co2_max is null").select("brand", c("title").alias("article_title"), "source_url", found.alias("co2_shaped_matches"))
    reports = tables.select(F.to_json(F.struct(F.array(F.struct("*")).alias("tripwire"))).alias("value"))
    return readers.tripwire_rows(reports, ["BMW", "Mazda"]).select("crawl_brand", "model_article_title", "source_url", "reason", F.element_at("validation_errors", 1).alias("error"))


@_query()
def job13_price_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing priced end to end."""
    priced = price.price_listings(listings(spark, sf_dir), catalogue(spark, sf_dir), corpus.ordered_range(derive(spark, sf_dir, "engines")), "2025-07-10")
    return priced.withColumn("warnings", F.array_join("warnings", ","))


@_query()
def agg17_job10_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges for all cars of the catalogue, held against the emission that it states, by bands of score; a row without a band tells how many were asked and answered."""
    known = catalogue(spark, sf_dir)
    found = settled(backtest.answers(known, corpus.ordered_range(derive(spark, sf_dir, "engines"))))
    whole = backtest.coverage(known, found).select(F.lit(None).cast("double").alias("band"), c("answered").alias("n"), "contained", "asked")
    return backtest.by_band(found).unionByName(whole, allowMissingColumns=True)
