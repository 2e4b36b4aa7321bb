"""Keyed writes over plain tables: last writer wins, keep existing, prune, and latest by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str], order: list[Column]) -> DataFrame:
    """The table after new rows replaced old ones of the same key.

    Null keys are keys like any other. ``order`` tells which of several new rows of one key comes last; ``keep`` names columns that an old row keeps. One
    shuffle by key for both sides, which the same layout of both tables saves.
    """
    fresh = last_by(new, keys, order).withColumn("_has", F.lit(True))
    o = old.select(*[F.col(c).alias(f"_o_{c}") for c in old.columns], F.lit(True).alias("_had"))
    both = o.join(fresh, [o[f"_o_{k}"].eqNullSafe(fresh[k]) for k in keys], "full_outer")
    had, has = F.col("_had").isNotNull(), F.col("_has").isNotNull()
    value = lambda c: F.when(has & ~(had & F.lit(c in keep)), F.col(c)).otherwise(F.col(f"_o_{c}"))
    return both.select(*[value(c).alias(c) for c in old.columns])


def merged(state: DataFrame | None, batch: DataFrame, keys: list[str], keep: list[str], order: str) -> DataFrame:
    """``batch`` put into ``state`` whatever order batches come in: (columns of the batch, first_order, last_order).

    Of all rows of a key so far the one of the greatest ``order`` counts, and the one of the least for the columns in
    ``keep``. Both orders stand in the state. A batch that comes again changes nothing.
    """
    others = [c for c in batch.columns if c not in (*keys, *keep)]
    row = lambda names: F.struct(*names) if names else F.lit(None)
    rows = batch.select(*keys, row(keep).alias("_first"), row(others).alias("_last"), F.col(order).alias("first_order"), F.col(order).alias("last_order"))
    if state is not None:
        rows = rows.unionByName(state.select(*keys, row(keep).alias("_first"), row(others).alias("_last"), "first_order", "last_order"))
    one = rows.groupBy(*keys).agg(F.min_by("_first", F.struct("first_order", "_first")).alias("_first"), F.max_by("_last", F.struct("last_order", "_last")).alias("_last"), F.min("first_order").alias("first_order"), F.max("last_order").alias("last_order"))
    of = lambda c: F.col(c) if c in keys else F.col(f"_first.{c}" if c in keep else f"_last.{c}").alias(c)
    return one.select(*[of(c) for c in batch.columns], "first_order", "last_order")


def insert_ignored(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The table with new rows added whose key it lacks."""
    added = last_by(new, keys, order).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(added.select(*old.columns))


def pruned(table: DataFrame, review: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the rows whose key is under review."""
    return table.join(review.select(*keys).distinct(), keys, "left_anti")


def latest(events: DataFrame, key: str, payload: str, at: str) -> DataFrame:
    """The last payload of each key."""
    return events.groupBy(key).agg(F.max_by(payload, at).alias(payload), F.max(at).alias(at))


def write_replacing(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Writes the table anew, or only the partitions that occur in ``df``."""
    writer = df.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def split_outcomes(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site, error, listing columns) -> run rows and listing rows."""
    ok = F.col("error").isNull()
    done = runs.select("site", F.when(ok, "success").otherwise("failed").alias("status"), ok.cast("int").alias("listings_found"), (~ok).cast("int").alias("listings_failed"), F.left("error", F.lit(2048)).alias("error_message"))
    return done, runs.where(ok).drop("error")
