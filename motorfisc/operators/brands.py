"""Brand resolution joins against a small vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorfisc.functions import dims
from motorfisc.functions.similarity import indel_ratio
from motorfisc.functions.text import brand_slug, fold, tokens


#: Words of the longest spelling of a brand.
LONGEST = 4


def spellings() -> list[str]:
    """Every spelling of every brand, of fixed values."""
    return sorted({b for bs in dims.FOLDER_BRANDS.values() for b in bs} | set(dims.BRAND_ALIASES))


def vocabulary(spark: SparkSession) -> DataFrame:
    """(alias, brand): folded spellings of every brand; some 60 rows, of fixed values."""
    own = [(b, b) for bs in dims.FOLDER_BRANDS.values() for b in bs] + list(dims.BRAND_ALIASES.items())
    df = spark.createDataFrame(sorted(set(own)), "spelling string, brand string")
    return df.select(fold(F.col("spelling")).alias("alias"), "brand").dropDuplicates(["alias"])


def folders(spark: SparkSession) -> DataFrame:
    """(folder, allowed): the brands that a folder's price lists can hold."""
    return spark.createDataFrame(list(dims.FOLDER_BRANDS.items()), "folder string, allowed array<string>")


def canonical(df: DataFrame, raw: str = "raw_brand", out: str = "brand") -> DataFrame:
    """Adds the canonical spelling; an unknown brand stays as it is."""
    v = F.broadcast(vocabulary(df.sparkSession).withColumnRenamed("brand", "_known"))
    return df.join(v, fold(F.col(raw)) == v["alias"], "left").withColumn(out, F.coalesce("_known", raw)).drop("alias", "_known")


def named_in_text(df: DataFrame, key: str, text: Column, allowed: Column | None = None) -> DataFrame:
    """(key, named): the first brand named in a text, two-word names before one-word ones; rows without one don't appear.

    With ``allowed``, an array column, only its brands count.
    """
    v = F.broadcast(vocabulary(df.sparkSession))
    found = tokens(fold(text))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(found) - 1, F.lit(1))), lambda i: F.struct(F.lit(2).alias("width"), i.alias("at"), F.array_join(F.slice(found, i, 2), " ").alias("words")))
    ones = F.transform(found, lambda w, i: F.struct(F.lit(1).alias("width"), (i + 1).alias("at"), w.alias("words")))
    grams = df.where(F.size(found) > 0).select(key, (allowed if allowed is not None else F.lit(None).cast("array<string>")).alias("_allowed"), F.explode(F.concat(pairs, ones)).alias("g"))
    hits = grams.select(key, "_allowed", "g.*").join(v, F.col("words") == v["alias"])
    hits = hits.where(F.col("_allowed").isNull() | F.array_contains("_allowed", F.col("brand")))
    return hits.groupBy(key).agg(F.min_by("brand", F.struct(-F.col("width"), F.col("at"))).alias("named"))


def _slugs(spark: SparkSession) -> dict[str, str]:
    """Brand by slug of its spellings; some 60 of fixed values, told by the functions that read slugs of rows."""
    rows = vocabulary(spark).select(brand_slug(F.col("alias")).alias("s"), "brand").collect()
    return {s: brand for s, brand in sorted(rows, reverse=True)}


def slug_prefix(df: DataFrame, slug: str) -> DataFrame:
    """Adds ``brand`` and ``consumed``: the longest brand that the hyphen-separated slug starts with, and its words.

    Each row is looked up by its first words in a map of fixed values: no join, no shuffle.
    """
    known = F.create_map(*[F.lit(x) for pair in _slugs(df.sparkSession).items() for x in pair])
    words = F.split(F.lower(F.col(slug)), "-")
    at = lambda w: F.try_element_at(known, F.array_join(F.slice(words, 1, w), "-"))
    longest = [(w, at(w)) for w in range(LONGEST, 0, -1)]
    there = lambda w, found: (F.size(words) >= w) & found.isNotNull()
    brand = F.coalesce(*[F.when(there(w, found), found) for w, found in longest])
    consumed = F.coalesce(*[F.when(there(w, found), F.lit(w)) for w, found in longest], F.lit(0))
    return df.withColumns({"brand": brand, "consumed": consumed})


def snapped(rows: DataFrame, cutoff: float = 80.0) -> DataFrame:
    """(id, folder, raw_brand, text) -> (id, brand): the row's brand among those of its folder, or null.

    In order: the canonical spelling, a close misspelling, a brand named in the cell or the text, a folder's only
    brand. The misspelling stage compares distinct cells with the few brands of their folder.
    """
    own = canonical(rows, "raw_brand", "_canonical").join(F.broadcast(folders(rows.sparkSession)), "folder", "left")
    exact = F.when(F.array_contains("allowed", F.col("_canonical")), F.col("_canonical"))
    cells = own.where("raw_brand is not null and allowed is not null").select("folder", "raw_brand", "allowed").distinct().select("folder", "raw_brand", F.posexplode("allowed").alias("at", "candidate"))
    close = cells.withColumn("ratio", indel_ratio(fold(F.col("raw_brand")), fold(F.col("candidate")))).where(F.col("ratio") >= cutoff)
    close = close.groupBy("folder", "raw_brand").agg(F.max_by("candidate", F.struct("ratio", -F.col("at"))).alias("_close"))
    named = named_in_text(own, "id", F.concat_ws(" ", "raw_brand", "text"), F.col("allowed"))
    out = own.join(close, ["folder", "raw_brand"], "left").join(named, "id", "left")
    only = F.when(F.size("allowed") == 1, F.element_at("allowed", 1))
    return out.select("id", F.coalesce(exact, "_close", "named", only).alias("brand"))
