"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
NO_WORD = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that intermediate results are written to.

    It is the one in ``spark.checkpoint.dir``. Where that is unset, a temporary folder is set if all runs on this machine
    (tests); on a cluster that raises, as executors would not share it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it from there, which cuts its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def bounded_sample(df: DataFrame, rows: int, seed: str, *key: str) -> DataFrame:
    """``rows`` rows of ``df`` at most, one for each ``key``: those of the least hashes of it, the same in every run.

    It holds as many as there are keys, or ``rows``. A threshold from the estimated number of distinct keys leaves
    little more than ``rows`` of them before anything is sorted, so that what is moved doesn't grow with the table or
    its tasks; should it leave too few, it is widened. Of the rows of one key the least by all columns is taken; rows
    whose key is null have one key.
    """
    share = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / float(1 << 53)
    marked = df.withColumn("_share", share)
    n = df.select(share.alias("_share")).agg(F.approx_count_distinct("_share", 0.01)).first()[0]
    least = (rows + 8 * rows**0.5 + 32) / max(1, n)
    while True:
        within = marked.where(F.col("_share") < least) if least < 1 else marked
        found = settle(within.groupBy("_share").agg(F.min(F.struct(*df.columns)).alias("_row")))
        if least >= 1 or found.count() >= rows:
            return found.orderBy("_share").limit(rows).select("_row.*")
        least *= 4


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shielded(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with the columns that have one of the names renamed, and the columns that give back those of ``df`` as they were."""
    clash = [c for c in df.columns if c.lower() in {n.lower() for n in names}]
    new = dict(zip(clash, free_names(df, *[f"_given_{c}" for c in clash]), strict=True))
    return df.withColumnsRenamed(new), [F.col(f"`{new.get(c, c)}`").alias(c) for c in df.columns]


def n_words(text: Column) -> Column:
    """Words of a text as long; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))
