"""The engine table's load: brand check, order, validation, upsert, prune and tripwires in one committed write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorfisc.operators import articles, corpus, upsert
from motorfisc.session import settled
from motorfisc.sources import versions

c = F.col
KEYS = ["source_fingerprint", "variant_index"]
_REVIEW = [*KEYS, "crawl_brand", "title", "reason", "errors"]


def checked(variants: DataFrame) -> DataFrame:
    """Variants (crawl_brand, title, ...) with brand_check and ``brand``, the one that their article's title files them under."""
    given = variants.drop("brand", "brand_check").withColumnRenamed("crawl_brand", "brand")
    return articles.brand_checks(given).withColumnRenamed("filed_under", "brand")


def tripwires(found: DataFrame, variants: DataFrame) -> DataFrame:
    """Tables (fingerprint, title, crawl_brand, table) with figures that look like emissions but no variant that has one.

    They can't be loaded, as there is nothing to load, and are never mended: rows of the review queue without a variant.
    """
    told = variants.where("co2_min is not null or co2_max is not null").select(c("source_fingerprint").alias("fingerprint")).distinct()
    shaped = found.withColumn("errors", articles.co2_shaped(c("table"))).where(F.size("errors") > 0).join(told, "fingerprint", "left_anti")
    return shaped.select(c("fingerprint").alias("source_fingerprint"), F.lit(None).cast("int").alias("variant_index"), "crawl_brand", "title", F.lit("tripwire").alias("reason"), "errors")


def load(spark: SparkSession, path: str, variants: DataFrame, writer: str, batch: int, suspects: DataFrame | None = None, order: str = "engine_id") -> bool:
    """Puts variants into the table of versions at ``path``: parts ``rows`` and ``review``, committed together.

    Variants have crawl_brand, title, the keys, the engine's figures and ``order``, by which the last of several rows of
    one key counts. A row that keeps all rules is put in by key; one held for review takes the row of its key out, as a
    row that was fine in an earlier run may not be now; keys that the run doesn't have stay as they are. ``review`` is
    this run's queue, with the suspects. False if the writer's batch was loaded before. Null keys are keys like any
    other; a run without rows commits the table as it was, with an empty queue.
    """
    own = settled(corpus.load_engines(checked(variants)))
    columns = [x for x in own.columns if x not in ("review_reason", "errors")]
    fine = own.where("review_reason is null").select(*columns)
    held = own.where("review_reason is not null").select(*KEYS, "crawl_brand", "title", c("review_reason").alias("reason"), "errors")
    queue = held if suspects is None else held.unionByName(suspects.select(*_REVIEW))

    def make(old):
        before = old("rows")
        rows = fine if before is None else upsert.upserted(before, fine, KEYS, [], [F.desc(order)])
        return {"rows": _without(rows, held), "review": queue}

    return versions.commit(spark, path, make, writer, batch)


def _without(rows: DataFrame, held: DataFrame) -> DataFrame:
    gone = held.select(*[c(k).alias(f"_{k}") for k in KEYS]).distinct()
    return rows.join(gone, [c(k).eqNullSafe(c(f"_{k}")) for k in KEYS], "left_anti")
