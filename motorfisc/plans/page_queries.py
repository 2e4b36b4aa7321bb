"""Listing pages, payloads and articles, laid out from ``part``, with SQL twins that know what was laid out."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorfisc.operators import articles as art
from motorfisc.operators import harvest as hv
from motorfisc.operators import listings as lst
from motorfisc.operators import statistics
from motorfisc.plans.derived import SQL, derive, duck
from motorfisc.session import checkpoint_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col

_BASE = SQL["cars"]
SQL["detail_pages"] = f"""
SELECT id AS page_id, concat('https://suchen.mobile.de/fahrzeuge/', CAST(id AS STRING_TYPE), '.html') AS url, model, raw_brand, kw, km, day, price, kind,
  concat('<html><head><script type="application/ld+json">', CASE WHEN kind % 3 = 0 THEN concat('{{"@type": "Car", "brand": {{"name": "', trim(raw_brand), '"}}, "model": "', model, '", "offers": {{"price": "', price, '"}}}}') ELSE '{{"@type": "WebPage", "model": "no"}}' END, '</script></head><body><span class="preis">', price, '.000 €</span>',
    CASE kind % 3 WHEN 0 THEN concat('<dl><dt>Marke:</dt><dd>', raw_brand, '</dd><dt>Modell</dt> <dd><b>', model, '</b></dd><dt>Erstzulassung</dt><dd>', day, '</dd><dt>Leistung (kW)</dt><dd>', kw, ' kW (1 PS)</dd></dl>')
      WHEN 1 THEN concat('<table><tr><th>Marka</th><td>', raw_brand, '</td></tr><tr><th>Model</th><td>', model, '</td></tr><tr><td>Prva registracija</td><td>', day, '</td></tr><tr><td>Snaga motora</td><td>', kw, ' kW</td></tr></table>')
      ELSE concat('<ul><li>Make: ', raw_brand, '</li><li>Model: <i>', model, '</i></li><li>First registration: ', day, '</li><li>Power: ', kw, 'kW</li><li>no label here</li></ul>') END,
    '<ul><li>Kilometerstand: ', km, ' km</li><li>Kraftstoff: ', CASE WHEN kind % 2 = 0 THEN 'Diesel' ELSE 'Benzin' END, '</li></ul></body></html>') AS html
FROM (SELECT *, CAST(id AS BIGINT) AS kind, CAST(CAST(coalesce(power_kw, 77) AS BIGINT) AS STRING_TYPE) AS kw, concat(CAST(10 + id % 80 AS STRING_TYPE), '.', lpad(CAST(id % 1000 AS STRING_TYPE), 3, '0')) AS km, concat('0', CAST(1 + id % 9 AS STRING_TYPE), '.', CAST(2010 + id % 12 AS STRING_TYPE)) AS day, CAST(11 + id % 70 AS STRING_TYPE) AS price FROM ({_BASE}) b) x"""

_INNER = 'concat(\'"make": {"name": "\', trim(raw_brand), \'"}, "model": {"name": "12\', CAST(id % 10 AS STRING_TYPE), \'"}, "modelVersionInput": "\', suffix, \' M Sport", "price": {"value": \', CAST(CAST(floor(price_eur) AS BIGINT) AS STRING_TYPE), \'}, "fuelCategory": {"raw": "\', CASE WHEN id % 2 = 0 THEN \'D\' ELSE \'2\' END, \'"}, "rawPowerInKw": \', CAST(50 + id % 100 AS STRING_TYPE), \', "mileageInKmRaw": \', CAST(id * 7 AS STRING_TYPE), \', "seats": \', CAST(id % 25 AS STRING_TYPE), \', "offerType": "\', CASE id % 3 WHEN 0 THEN \'N\' WHEN 1 THEN \'u\' ELSE \'D\' END, \'"\')'
SQL["state_pages"] = f"""
SELECT concat('https://www.autoscout24.de/', CAST(id AS STRING_TYPE)) AS url, id, raw_brand, suffix, price_eur,
  CASE id % 5 WHEN 0 THEN concat('{{"props": {{"pageProps": {{"listingDetails": {{"vehicle": {{', inner_json, '}}}}}}}}}}') WHEN 1 THEN concat('{{"props": {{"pageProps": {{"listing": {{', inner_json, '}}}}}}}}') WHEN 2 THEN concat('{{"props": {{"pageProps": {{"data": {{"listing": {{', inner_json, '}}}}}}}}}}') WHEN 3 THEN concat('{{"props": {{"pageProps": {{"item": {{', inner_json, '}}}}}}}}') ELSE '{{"broken": ' END AS payload
FROM (SELECT *, {_INNER} AS inner_json FROM (SELECT *, CASE id % 4 WHEN 0 THEN 'xd' WHEN 1 THEN 'i' WHEN 2 THEN 'Touring' ELSE 'd' END AS suffix FROM ({_BASE}) b) y) x"""

SQL["actor_items"] = f"""
SELECT id AS item_id, raw_brand, model, concat('{{"manufacturer": "', trim(raw_brand), '", "model": "', model, '", "subTitle": "sub", "price": {{"amount": ', CAST(CAST(floor(price_eur) AS BIGINT) AS STRING_TYPE), '}}, "properties": {{"firstRegistration": "0', CAST(1 + id % 9 AS STRING_TYPE), '/2019", "power": "', CAST(50 + id % 100 AS STRING_TYPE), ' kW (80 hp)", "co2Emission": "', CAST(90 + id % 60 AS STRING_TYPE), ',5 g/km (komb.)", "fuelType": "',
  CASE id % 4 WHEN 0 THEN 'Hybrid (Diesel/Elektro)' WHEN 1 THEN 'Benzin' WHEN 2 THEN 'Elektro' ELSE 'steam' END, '", "milage": "', CAST(10 + id % 80 AS STRING_TYPE), ',', lpad(CAST(id % 1000 AS STRING_TYPE), 3, '0'), ' km", "vin": "wba', lpad(CAST(id AS STRING_TYPE), 14, '0'), '"}}}}') AS payload, price_eur
FROM ({_BASE}) b"""

SQL["wiki_articles"] = """
SELECT concat('Article ', CAST(p_partkey AS STRING_TYPE)) AS title, p_partkey AS id,
  concat('Lead with [[Lead link]].', NL, '== Modelle ==', NL, '{{Hauptartikel|Brand main ', CAST(p_partkey % 50 AS STRING_TYPE), '}}', NL, '* [[Brand ', p_name, '|shown]] and [[:Datei:x.jpg]] and [[brand ', p_name, '#Motoren]]', NL, '* [[Brand ', p_name, ']] again, [[en:Other]]', NL, '=== Ottomotoren ===', NL,
    '{| class="wikitable"', NL, '|-', NL, '! Motor !! Hubraum !! CO<sub>2</sub>', NL, '|-', NL, '| 1.', CAST(p_partkey % 10 AS STRING_TYPE), ' || ', CAST(1000 + p_size AS STRING_TYPE), ' || ', CAST(100 + p_size AS STRING_TYPE), ' g/km', NL, '|}', NL,
    '== Technik ==', NL, 'Text.', NL, '{|', NL, '|-', NL, '! Leistung', NL, '| ', CAST(p_size AS STRING_TYPE), ' kW', NL, '|-', NL, '! Hubraum', NL, '| [[Liter|', CAST(p_size AS STRING_TYPE), ']] at ', CAST(100 + p_size AS STRING_TYPE), ' g/km', NL, '|}', NL) AS wikitext, p_name, p_size
FROM {part}"""
SQL["wiki_articles"] = SQL["wiki_articles"].replace("NL", "chr(10)")


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _from(name: str) -> str:
    return f"({duck(SQL[name])}) s"


@_query(f"SELECT page_id, 'mobile.de' AS source_site, CAST(page_id AS VARCHAR) AS listing_id, trim(regexp_replace(raw_brand, '\\s+', ' ', 'g')) AS brand, model, CAST(price AS DOUBLE) * 1000 AS price_eur, CAST(right(day, 4) || '-' || left(day, 2) || '-01' AS DATE) AS registered, CAST(kw AS DOUBLE) AS power_kw, CAST(replace(km, '.', '') AS INT) AS mileage_km, CASE WHEN kind % 2 = 0 THEN 'diesel' ELSE 'petrol' END AS fuel_type FROM {_from('detail_pages')}")
def job6_src11_page_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows of detail pages in three layouts and three languages."""
    return lst.page_listings(derive(spark, sf_dir, "detail_pages")).select("page_id", "source_site", "listing_id", "brand", "model", "price_eur", "registered", "power_kw", "mileage_km", "fuel_type")


@_query(f"SELECT page_id, trim(raw_brand) AS brand, model, CAST(price AS DOUBLE) AS price_eur FROM {_from('detail_pages')} WHERE kind % 3 = 0")
def src12_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cars that pages state as linked data."""
    return lst.json_ld(derive(spark, sf_dir, "detail_pages"))


@_query(f"SELECT url, CASE WHEN ok THEN trim(raw_brand) END AS brand, CASE WHEN ok THEN '12' || CAST(id % 10 AS VARCHAR) || CASE id % 4 WHEN 0 THEN 'd' WHEN 1 THEN 'i' WHEN 2 THEN '' ELSE 'd' END END AS model, CASE WHEN ok THEN floor(price_eur) END AS price_eur, CASE WHEN ok THEN CASE WHEN id % 2 = 0 THEN 'diesel' ELSE 'petrol' END END AS fuel_type, CASE WHEN ok THEN CAST(50 + id % 100 AS DOUBLE) END AS power_kw, CASE WHEN ok THEN CAST(id * 7 AS INT) END AS mileage_km, CASE WHEN ok AND id % 25 BETWEEN 1 AND 20 THEN CAST(id % 25 AS INT) END AS seat_count, CASE WHEN ok THEN CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS is_new FROM (SELECT *, id % 5 < 4 AS ok FROM {_from('state_pages')}) t")
def src9_num11_state_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows of JSON states, the listing lying in four places."""
    return lst.state_listings(derive(spark, sf_dir, "state_pages")).select("url", "brand", "model", "price_eur", "fuel_type", "power_kw", "mileage_km", "seat_count", "is_new")


@_query(f"SELECT item_id, trim(raw_brand) AS brand, model, floor(price_eur) AS price_eur, CAST('2019-0' || CAST(1 + item_id % 9 AS VARCHAR) || '-01' AS DATE) AS registered, CAST(50 + item_id % 100 AS DOUBLE) AS power_kw, CASE item_id % 4 WHEN 0 THEN 'diesel' WHEN 1 THEN 'petrol' WHEN 2 THEN 'electric' END AS fuel_type, CAST((10 + item_id % 80) * 1000 + item_id % 1000 AS INT) AS mileage_km, 'WBA' || lpad(CAST(item_id AS VARCHAR), 14, '0') AS vin FROM {_from('actor_items')}")
def src10_actor_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing rows of actor items."""
    return lst.actor_listings(derive(spark, sf_dir, "actor_items")).select("item_id", "brand", "model", "price_eur", "registered", "power_kw", "fuel_type", "mileage_km", "vin")


@_query("WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT DISTINCT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href AS url FROM l")
def src13_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the given pages with absolute addresses."""
    return art.page_links(table(spark, sf_dir, "pages")).select("page_id", "url")


@_query(f"SELECT title, unnest([0, 1]) AS pos, unnest(['Modelle', 'Technik']) AS heading FROM {_from('wiki_articles')}")
def arr5_flt14_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-2 sections of each article."""
    return art.sections(derive(spark, sf_dir, "wiki_articles", spread=True)).select("title", "pos", "heading")


@_query(f"SELECT title, unnest(['Brand main ' || CAST(id % 50 AS VARCHAR), 'Brand ' || p_name, 'Brand ' || p_name]) AS target, unnest([NULL, NULL, 'Motoren']) AS anchor FROM {_from('wiki_articles')}")
def job7_arr4_flt13_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article links of model sections, namespaces and repeats left out."""
    found = art.links(art.model_sections(art.sections(derive(spark, sf_dir, "wiki_articles", spread=True))))
    return art.brand_links(found, F.lit("brand")).select("title", "target", "anchor")


@_query(f"SELECT title, 3 AS links, true AS escalate FROM {_from('wiki_articles')}")
def flt15_agg13_crawl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each article, and whether they are too few."""
    return art.crawl_report(derive(spark, sf_dir, "wiki_articles", spread=True))


@_query(f"SELECT title, unnest(['Modelle / Ottomotoren', 'Technik']) AS path, unnest([true, false]) AS has_co2, unnest([CAST(100 + p_size AS VARCHAR), CAST(100 + p_size AS VARCHAR)]) AS shaped FROM {_from('wiki_articles')}")
def arr1_win9_flt10_flt11_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with the headings above them, and the emission figures in them."""
    found = art.tables(derive(spark, sf_dir, "wiki_articles", spread=True))
    return found.select("title", F.array_join("heading_path", " / ").alias("path"), art.has_co2(c("table")).alias("has_co2"), F.array_join(art.co2_shaped(c("table")), ",").alias("shaped"))


@_query(f"SELECT title, 'first' AS which, 'Motor|Hubraum|CO2|1.' || CAST(id % 10 AS VARCHAR) || '|' || CAST(1000 + p_size AS VARCHAR) || '|' || CAST(100 + p_size AS VARCHAR) || ' g/km' AS texts FROM {_from('wiki_articles')} UNION ALL SELECT title, 'second', 'Leistung|' || CAST(p_size AS VARCHAR) || ' kW|Hubraum|' || CAST(p_size AS VARCHAR) || ' at ' || CAST(100 + p_size AS VARCHAR) || ' g/km' FROM {_from('wiki_articles')}")
def arr2_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of each table in order."""
    found = art.tables(derive(spark, sf_dir, "wiki_articles", spread=True)).withColumn("which", F.when(F.size("heading_path") == 2, "first").otherwise("second")).withColumn("fingerprint", F.concat_ws("/", "title", "which"))
    texts = art.cells(found).groupBy("fingerprint").agg(F.array_sort(F.collect_list(F.struct("row", "col", "text"))).alias("x"))
    parts = F.split("fingerprint", "/")
    return texts.select(parts[0].alias("title"), parts[1].alias("which"), F.array_join(F.transform("x", lambda x: x["text"]), "|").alias("texts"))


@_query(f"SELECT title, unnest(['normal', 'transposed']) AS orientation FROM {_from('wiki_articles')}")
def cat12_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which axis of each table has the labels."""
    found = art.tables(derive(spark, sf_dir, "wiki_articles", spread=True)).withColumn("fingerprint", F.concat_ws("/", "title", "at", "segment"))
    return art.orientation(art.cells(found)).select(F.split("fingerprint", "/")[0].alias("title"), "orientation")


@_query(f"SELECT title, CASE id % 4 WHEN 0 THEN 'ottomotoren' WHEN 1 THEN 'Otto' WHEN 2 THEN 'Elsewhere' END AS anchor, CASE id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS tier, CASE WHEN id % 4 < 2 THEN 1 ELSE 2 END AS n FROM {_from('wiki_articles')}")
def job8_jn16_tables_for_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables in scope of each crawled anchor."""
    wiki = derive(spark, sf_dir, "wiki_articles", spread=True)
    asked = wiki.select("title", F.when(c("id") % 4 == 0, "ottomotoren").when(c("id") % 4 == 1, "Otto").when(c("id") % 4 == 2, "Elsewhere").alias("anchor"))
    return art.for_anchor(art.tables(wiki), asked).groupBy("title", "anchor", "tier").agg(F.count(F.lit(1)).cast("int").alias("n"))


@_query(f"SELECT count(*) AS articles, 2 * count(*) AS tables_seen, count(*) AS tables_kept, 0.5::DOUBLE AS share FROM {_from('wiki_articles')}")
def agg16_prefilter_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tables of all articles have emissions; half of the articles are stored twice."""
    wiki = derive(spark, sf_dir, "wiki_articles", spread=True)
    return art.prefilter_yield(wiki.unionByName(wiki.where("id % 2 = 0")))


def _redirected(people: DataFrame, asked: DataFrame) -> DataFrame:
    hops = people.where("c_custkey % 10 > 0").select(c("c_custkey").cast("string").alias("from_title"), (c("c_custkey") - 1).cast("string").alias("to_title"))
    loops = people.where("c_custkey % 10 = 0").select(c("c_custkey").cast("string").alias("from_title"), c("c_custkey").cast("string").alias("to_title"))
    found = art.resolved(asked.select(c("c_custkey").cast("string").alias("title")), hops.unionByName(loops)).drop("fragment")
    return found.select(c("title").cast("long").alias("title"), c("final").cast("long").alias("final"), "hops")


@_query("SELECT c_custkey AS title, CASE WHEN c_custkey % 10 = 0 THEN c_custkey ELSE c_custkey - c_custkey % 10 END AS final, CAST(c_custkey % 10 AS INT) AS hops FROM customer")
def jn18_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys followed through chains of redirects."""
    people = table(spark, sf_dir, "customer")
    return _redirected(people, people)


@_query("WITH c AS (SELECT p_partkey AS id, unnest(['Brand#1', p_brand, p_name]) AS cand, unnest([0, 1, 2]) AS pos FROM part), r AS (SELECT DISTINCT p_brand AS t, p_brand NOT IN ('Brand#1', 'Brand#2') AS good FROM part) SELECT id, arg_min(cand, pos) AS article FROM c JOIN r ON cand = t WHERE good GROUP BY id")
def jn20_first_acceptable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several candidate titles that exists and isn't a list."""
    parts = table(spark, sf_dir, "part")
    known = parts.select(c("p_brand").alias("t")).distinct().withColumn("good", ~c("t").isin("Brand#1", "Brand#2"))
    each = parts.select(c("p_partkey").alias("id"), F.posexplode(F.array(F.lit("Brand#1"), "p_brand", "p_name")).alias("pos", "cand"))
    return each.join(known, c("cand") == c("t")).where("good").groupBy("id").agg(F.min_by("cand", "pos").alias("article"))


@_query("SELECT c.c_custkey AS id, CASE WHEN o.n IS NULL THEN 'not_found' ELSE 'ok' END AS status, coalesce(o.n, 0) AS n FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def jn10_jn17_resolved_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with what is stored for them, missing ones kept and marked."""
    stored = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").join(stored, c("c_custkey") == c("o_custkey"), "left").select(c("c_custkey").alias("id"), F.when(c("n").isNull(), "not_found").otherwise("ok").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


_K = "(SELECT p_partkey AS id, CAST(p_partkey AS STRING_TYPE) AS k, CAST(p_partkey + 1 AS STRING_TYPE) AS j FROM {part})"
_ARTICLES = {
    "'Marke ', k": "'== Modelle ==', NL, '{{Hauptartikel|Liste ', k, '}} {{Hauptartikel|Marke ', j, '}} {{Hauptartikel|Motorrad ', k, '}}', NL, '* [[Marke ', k, ' Uno]] [[Kurz ', k, ']] [[Fremd ', k, ']] [[Marke%20', k, '_Uno|x]]', NL, '== Anderes ==', NL, '[[Marke ', k, ' Nie]]'",
    "'Liste ', k": "'== PKW ==', NL, '[[Marke ', k, ' Due#Motoren]] {{Hauptartikel|Liste ', k, ' b}} [[Marke ', k, ' Uno]]'",
    "'Liste ', k, ' b'": "'== X ==', NL, '[[Marke ', k, ' Tre]] {{Hauptartikel|Liste ', k, '}} {{Hauptartikel|Liste ', k, ' c}}'",
    "'Liste ', k, ' c'": "'== Y ==', NL, '[[Marke ', k, ' Zu weit]]'",
    **{f"'Marke ', k, ' {x}'": "'text'" for x in ("Uno", "Due", "Vier")},
    "'Fremd ', k": "'text'",
}
SQL["harvest_articles"] = " UNION ALL ".join([*(f"SELECT concat({t}) AS title, concat({w}) AS wikitext FROM {_K} p" for t, w in _ARTICLES.items()), f"SELECT concat('Marke ', k, ' Tre') AS title, 'text' AS wikitext FROM {_K} p WHERE id % 3 > 0"]).replace("NL", "chr(10)")
SQL["harvest_redirects"] = f"SELECT concat('Kurz ', k) AS from_title, concat('Kurz alt ', k) AS to_title, CASE WHEN id % 2 = 0 THEN 'Erst' END AS to_fragment FROM {_K} p UNION ALL SELECT concat('Kurz alt ', k), concat('Marke ', k, ' Vier'), CASE WHEN id % 4 < 2 THEN 'Zweiter_Teil' END FROM {_K} p"
SQL["harvest_brands"] = f"SELECT concat('B', k) AS brand, concat('Marke ', k) AS title, concat('Marke ', k) AS prefix FROM {_K} p"

#: The links that were laid out, walked over two hops, and followed through redirects.
_EDGES = " UNION ALL ".join(
    f"SELECT 'B' || k AS brand, 'Marke ' || k AS prefix, {src} AS src, {target} AS target, {anchor} AS anchor, {main} AS main FROM p"
    for src, target, anchor, main in [
        *[("'Marke ' || k", t, "NULL", m) for t, m in (("'Liste ' || k", "true"), ("'Marke ' || j", "true"), ("'Motorrad ' || k", "true"), ("'Marke ' || k || ' Uno'", "false"), ("'Kurz ' || k", "false"), ("'Fremd ' || k", "false"))],
        ("'Liste ' || k", "'Marke ' || k || ' Due'", "'Motoren'", "false"), ("'Liste ' || k", "'Liste ' || k || ' b'", "NULL", "true"), ("'Liste ' || k", "'Marke ' || k || ' Uno'", "NULL", "false"),
        ("'Liste ' || k || ' b'", "'Marke ' || k || ' Tre'", "NULL", "false"), ("'Liste ' || k || ' b'", "'Liste ' || k", "NULL", "true"), ("'Liste ' || k || ' b'", "'Liste ' || k || ' c'", "NULL", "true"), ("'Liste ' || k || ' c'", "'Marke ' || k || ' Zu weit'", "NULL", "false"),
    ]
)
_WALK = f"""WITH RECURSIVE p AS {duck(_K)}, a AS ({duck(SQL['harvest_articles'])}), r AS ({duck(SQL['harvest_redirects'])}), e AS ({_EDGES}),
f AS (SELECT 'B' || k AS brand, 'Marke ' || k AS title, 0 AS depth FROM p UNION SELECT f.brand, e.target, f.depth + 1 FROM f JOIN e ON e.brand = f.brand AND e.src = f.title WHERE e.main AND f.depth < 2 AND NOT starts_with(e.target, e.prefix) AND e.target NOT IN (SELECT 'Marke ' || k FROM p) AND NOT contains(lower(e.target), 'motorrad')),
w AS (SELECT from_title AS title, to_title AS final, to_fragment AS fragment FROM r UNION ALL SELECT w.title, r.to_title, coalesce(r.to_fragment, w.fragment) FROM w JOIN r ON r.from_title = w.final),
x AS (SELECT title, final, fragment FROM w WHERE final NOT IN (SELECT from_title FROM r)),
l AS (SELECT e.brand, e.prefix, e.target, e.anchor, f.depth, NOT (e.main OR starts_with(e.target, e.prefix)) AS rescued, coalesce(x.final, e.target) AS final, x.fragment, coalesce(x.final, e.target) IN (SELECT title FROM a) AS there FROM f JOIN e ON e.brand = f.brand AND e.src = f.title LEFT JOIN x ON x.title = e.target),
h AS (SELECT brand, CASE WHEN there THEN final ELSE target END AS title, CASE WHEN there THEN coalesce(anchor, replace(fragment, '_', ' ')) ELSE anchor END AS anchor, CASE WHEN there THEN 'ok' ELSE 'missing' END AS state, rescued, depth FROM l WHERE NOT rescued OR depth = 0 AND there AND starts_with(final, prefix)),
g AS (SELECT brand, title, anchor, state, min(rescued) AS rescued, min(depth) AS depth FROM h GROUP BY ALL)"""


def _harvest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    brands = derive(spark, sf_dir, "harvest_brands").select("brand", "title", F.array("prefix").alias("prefixes"))
    texts = derive(spark, sf_dir, "harvest_articles", spread=True)
    return brands, texts, hv.harvest(brands, texts, derive(spark, sf_dir, "harvest_redirects"), hops=2)


@_query(f"{_WALK} SELECT * FROM g")
def job7_jn17_flt13_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model articles of every brand, two index hops deep, with short names rescued by redirects and their last fragments."""
    return _harvest(spark, sf_dir)[2]


@_query(f"{_WALK} SELECT brand, CAST(4 AS BIGINT) AS direct, count(*) AS pairs, count(*) FILTER (WHERE rescued) AS rescued, count(*) FILTER (WHERE depth > 0) AS from_index, count(*) FILTER (WHERE state = 'missing') AS missing, count(DISTINCT CASE WHEN state = 'ok' THEN title END) AS articles, true AS escalate FROM g GROUP BY brand")
def job7_agg13_harvest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the harvest of each brand found, and how."""
    return hv.report(*_harvest(spark, sf_dir))


_MARKED = "CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END"


@_query(f"SELECT 2 * count(*) AS tables, count(*) AS with_co2, count(*) AS words_normal, count(*) AS words_transposed, CAST(0 AS BIGINT) AS words_no_header_cells, CAST(sum({_MARKED}) AS BIGINT) AS marks_normal, CAST(sum({_MARKED}) AS BIGINT) AS marks_transposed, CAST(2 * sum(1 - {_MARKED}) AS BIGINT) AS marks_no_header_cells, CAST(2 * sum({_MARKED}) AS BIGINT) AS agreeing FROM {_from('wiki_articles')}")
def agg10_run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a run over all tables, observed while it writes them; every third article has no cells marked as headers."""
    wiki = derive(spark, sf_dir, "wiki_articles", spread=True).withColumn("wikitext", F.when(c("id") % 3 == 0, F.translate("wikitext", "!", "|")).otherwise(c("wikitext")))
    got = statistics.write_observed(statistics.analysed(art.tables(wiki)), f"{checkpoint_folder(spark)}/tables-{uuid4().hex}", statistics.totals())
    return spark.createDataFrame([tuple(got[k] for k in statistics.totals())], ", ".join(f"{k} long" for k in statistics.totals()))
