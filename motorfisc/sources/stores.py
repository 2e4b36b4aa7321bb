"""Tables stored by brand or by day, and scans that open the partitions asked for and no others."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
BRAND, DAY = "_brand", "_day"
#: Rows of a stored file on average at least; a day or brand with many more is written by several tasks.
FILE_ROWS = 1 << 20


def _write(rows: DataFrame, by: str, path: str) -> None:
    """Writes rows into folders by a column; a hot value is dealt to as many tasks as its rows fill files, the others to one each."""
    sizes = rows.groupBy(c(by).alias("_by")).agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).cast("int").alias("_files"))
    dealt = rows.join(sizes, c(by).eqNullSafe(c("_by")), "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), c("_files")))
    dealt.repartition(by, "_part").select(*rows.columns).write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_catalogue(catalogue: DataFrame, path: str) -> None:
    """A catalogue by lower-cased brand; brands that occur replace their partition, the others stay. Null brands are one partition."""
    _write(catalogue.withColumn(BRAND, F.lower("brand")), BRAND, path)


def catalogue_scan(spark: SparkSession, path: str, *brands: str) -> DataFrame:
    """The rows of some brands, however capitalized: only their partitions are opened. Without brands, all rows."""
    rows = spark.read.parquet(path)
    return (rows.where(c(BRAND).isin([b.lower() for b in brands])) if brands else rows).drop(BRAND)


def catalogue_for(spark: SparkSession, path: str, listings: DataFrame) -> DataFrame:
    """The rows of the listings' brands: which partitions are opened is decided from the listings as the query runs.

    The brands are told apart first, and so few of them are joined that they are broadcast; a listing without a brand
    asks for none.
    """
    asked = listings.where(c("brand").isNotNull()).select(F.lower("brand").alias("_asked")).distinct()
    return spark.read.parquet(path).join(F.broadcast(asked), c(BRAND) == c("_asked"), "left_semi").drop(BRAND)


def write_events(events: DataFrame, path: str) -> None:
    """An event log by day; days that occur replace theirs. Events without a time are one partition."""
    _write(events.withColumn(DAY, F.to_date("ts")), DAY, path)


def event_scan(spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None, kinds: list[str] | None = None, clients: list | None = None, client: str = "user_id") -> DataFrame:
    """Events from ``since`` on and before ``until``, of some kinds and clients: only the days that can have them are opened.

    Events without a time are in a scan without bounds only.
    """
    rows = spark.read.parquet(path)
    kind = rows.schema["ts"].dataType
    if since is not None:
        rows = rows.where((c(DAY) >= F.lit(since.date())) & (c("ts") >= F.lit(since).cast(kind)))
    if until is not None:
        rows = rows.where((c(DAY) <= F.lit(until.date())) & (c("ts") < F.lit(until).cast(kind)))
    if kinds is not None:
        rows = rows.where(c("event_type").isin(kinds))
    if clients is not None:
        rows = rows.where(c(client).isin(clients))
    return rows.drop(DAY)


def day_scan(spark: SparkSession, path: str, *days: date) -> DataFrame:
    """The events of some days."""
    return spark.read.parquet(path).where(c(DAY).isin(list(days))).drop(DAY)
