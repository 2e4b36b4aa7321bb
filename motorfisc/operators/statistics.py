"""Statistics of a run, observed while its rows are written: totals cost no second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from motorfisc.operators import articles

c = F.col
ORIENTATIONS = ("normal", "transposed", "no_header_cells")


def by_marks(table_cells: DataFrame) -> DataFrame:
    """(fingerprint, by_marks): which axis has the labels by the cells that are marked as headers, not by their words.

    A table whose first row has more marked cells than its first column (the corner aside) is normal, one with fewer
    transposed; as many in both, or none, say nothing.
    """
    edge = (c("row") == 0) != (c("col") == 0)
    counted = table_cells.groupBy("fingerprint").agg(F.count_if(c("is_header") & edge & (c("row") == 0)).alias("across"), F.count_if(c("is_header") & edge & (c("col") == 0)).alias("down"))
    return counted.select("fingerprint", F.when(c("across") > c("down"), "normal").when(c("across") < c("down"), "transposed").otherwise("no_header_cells").alias("by_marks"))


def analysed(found: DataFrame) -> DataFrame:
    """Tables (fingerprint, table, ...) with has_co2, and their orientation by words and by marks."""
    own = found.withColumn("has_co2", articles.has_co2(c("table")))
    cells = articles.cells(found.dropDuplicates(["fingerprint"]))
    both = articles.orientation(cells).join(by_marks(cells), "fingerprint")
    none = lambda x: F.coalesce(x, F.lit("no_header_cells")).alias(x)
    return own.join(both, "fingerprint", "left").select(*own.columns, none("orientation"), none("by_marks"))


def totals() -> dict[str, Column]:
    """The aggregates of ``analysed`` tables by name."""
    of = lambda column, kind: F.count_if(c(column) == kind)
    return {
        "tables": F.count(F.lit(1)),
        "with_co2": F.count_if(c("has_co2")),
        **{f"words_{k}": of("orientation", k) for k in ORIENTATIONS},
        **{f"marks_{k}": of("by_marks", k) for k in ORIENTATIONS},
        "agreeing": F.count_if(c("orientation") == c("by_marks")),
    }


def write_observed(rows: DataFrame, path: str, aggregates: dict[str, Column]) -> dict:
    """Writes rows as Parquet and returns the aggregates over all of them, taken as they are written.

    The figures are Spark's own observed metrics: tasks hand partial ones to the driver with their results, a row for
    each partition, and a task that is run again counts once.
    """
    seen = Observation()
    rows.observe(seen, *[x.alias(n) for n, x in aggregates.items()]).write.mode("overwrite").parquet(path)
    return dict(seen.get)
