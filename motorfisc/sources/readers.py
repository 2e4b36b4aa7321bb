"""Sources with a contract of their own: manifests, stores and reports in JSON, scans of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorfisc.functions.text import unmarked

MANIFEST = "url string, path string, brand string, year int, filename string"
STORE = "status:string,price_currency:string,confidence:double,fields:map<string,string>"
TRIPWIRE = "tripwire array<struct<brand:string,article_title:string,heading_context:string,source_url:string,co2_shaped_matches:array<string>,variants_returned:int>>"
VARIANTS = "array<struct<engine_code:string,production_start:string,production_end:string,displacement_cc:double,power_kw:double,fuel_type:string,co2_min:double,co2_max:double>>"


def manifest(spark: SparkSession, path: str, brand: str | None = None) -> DataFrame:
    """Manifest lines of a file; see ``manifest_lines``."""
    return manifest_lines(spark.read.text(path), brand)


def manifest_lines(lines: DataFrame, brand: str | None = None) -> DataFrame:
    """(value) JSON lines -> manifest rows, all or those of a brand, which may be given as a slug; unreadable lines are left out."""
    rows = _manifest(lines).where("reason is null").select("m.*")
    slug = lambda x: F.regexp_replace(unmarked(x), "[^a-z0-9]+", "-")
    return rows if brand is None else rows.where((F.col("brand") == brand) | (slug(F.col("brand")) == slug(F.lit(brand))))


def manifest_rest(lines: DataFrame) -> DataFrame:
    """(value) JSON lines -> (value, reason) of those that ``manifest_lines`` leaves out; blank lines are no lines."""
    return _manifest(lines).where("reason is not null").select("value", "reason")


def _manifest(lines: DataFrame) -> DataFrame:
    read = lines.where(F.trim("value") != "").withColumn("m", F.from_json("value", f"{MANIFEST}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    reason = F.when(F.col("m").isNull() | F.col("m._bad").isNotNull(), "no JSON object of this form").when(F.col("m.path").isNull(), "no path")
    return read.select("value", F.col("m").dropFields("_bad").alias("m"), reason.alias("reason"))


def mapping_store(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a store file that have a mapping; see ``mapping_entries``."""
    return mapping_entries(spark.read.text(path, wholetext=True))


def mapping_entries(texts: DataFrame) -> DataFrame:
    """(value) JSON objects by fingerprint -> entries that have a mapping; failures and what can't be read are left out."""
    found = texts.select(F.explode(F.from_json("value", f"map<string,struct<{STORE}>>")).alias("fingerprint", "e"))
    return found.where("e.status = 'ok'").select("fingerprint", "e.*")


def exploded_variants(store: DataFrame, column: str = "variants") -> DataFrame:
    """(fingerprint, variants as JSON) -> one row for each variant, with its place as variant_index."""
    return store.select("fingerprint", F.posexplode(F.from_json(column, VARIANTS)).alias("variant_index", "v")).select("fingerprint", "variant_index", "v.*")


def fetched(articles: DataFrame, brands: list[str] | None = None) -> DataFrame:
    """Stored articles that were fetched, of some brands or all."""
    ok = articles.where("fetch_status = 'ok'")
    return ok.where(F.col("brand").isin(brands)) if brands else ok


def tripwires(spark: SparkSession, path: str, brands: list[str] | None = None) -> DataFrame:
    """Review rows of a run report; see ``tripwire_rows``."""
    return tripwire_rows(spark.read.text(path, wholetext=True), brands)


def tripwire_rows(texts: DataFrame, brands: list[str] | None = None) -> DataFrame:
    """(value) run reports in JSON -> review rows of their tables with emission text but no emission, of some brands or all."""
    t = texts.select(F.explode(F.from_json("value", TRIPWIRE)["tripwire"]).alias("t")).select("t.*")
    t = t.where(F.col("brand").isin(brands)) if brands else t
    error = F.concat(F.lit("table returned no CO2 but its wikitext contains CO2-shaped text: "), F.array_join(F.coalesce("co2_shaped_matches", F.array().cast("array<string>")), ", "))
    return t.select(
        F.col("brand").alias("crawl_brand"), F.col("brand").alias("effective_brand"), F.lit(None).cast("string").alias("brand_check"), F.col("article_title").alias("model_article_title"), "heading_context", "source_url",
        F.lit("phase2_5_tripwire").alias("reason"), F.array(error).alias("validation_errors"), "variants_returned",
    )


def write_report(review: DataFrame, summary: DataFrame, path: str) -> None:
    """A review queue and a one-row summary as JSON."""
    review.write.mode("overwrite").json(f"{path}/review")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
