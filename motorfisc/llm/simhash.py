"""SimHash near-duplicate detection with pigeonring candidate filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from motorfisc.llm.common import settle, shielded, table
from motorfisc.llm.components import components

SEED, SHINGLE, BITS = 42, 3, 64
#: Most differing bits of a link.
RADIUS = 3
#: The fingerprint is a ring of so many segments of equal width.
SEGMENTS = 4
#: Fingerprints, each with some 70 keys, that a task of the search starts from.
SPREAD = 1 << 14
#: Hashes of rows that are broadcast at most (8 bytes each); more of them are joined by a shuffle.
BROADCAST_ROWS = 1 << 21
_WIDTH = BITS // SEGMENTS
_CHUNK = 1 << 16


def simhash(text: str | None) -> int:
    """Fingerprint of one text: bit b is 1 if it is set in over half of the shingle hashes; no words: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - size]]
    digest = xxhash.xxh64_intdigest
    n, ones = len(starts), np.zeros(BITS, dtype=np.int64)
    hashes = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)), dtype="<u8", count=n)
    for at in range(0, n, _CHUNK):
        part = hashes[at : at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series(np.fromiter((simhash(t) for t in part), dtype=np.int64, count=len(part)))


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, _WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << _WIDTH) - 1))


def _ring_key(i: int, first: Column, second: Column) -> Column:
    return F.lit(i << (2 * _WIDTH)).cast("long").bitwiseOR(F.shiftleft(first, _WIDTH)).bitwiseOR(second)


def _distance(a: str, b: str, segments: list[int]) -> Column:
    mask = sum(((1 << _WIDTH) - 1) << (_WIDTH * (i % SEGMENTS)) for i in segments)
    mask -= (1 << BITS) if mask >= 1 << (BITS - 1) else 0
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(F.lit(mask).cast("long")))


def near_links(fingerprints: DataFrame) -> DataFrame:
    """Distinct ``fp`` -> links (u, v), u < v, of at most RADIUS differing bits.

    Pigeonring: of fingerprints within RADIUS some segment starts a chain round the ring in which the first l segments
    together differ in at most l * RADIUS / SEGMENTS bits, for every l. With 4 segments and 3 bits these budgets are
    0, 1, 2 and 3. The first two are the join key: a segment as it is, and the next one as it is or with one bit
    turned; the other budgets prune the joined rows before the count over all 64 bits. The key is worth 32 bits, so
    the candidates of a fingerprint stay few at any size.
    """
    fp = F.col("fp")
    own = fingerprints.select(fp.alias("v"), F.explode(F.array(*[_ring_key(i, _segment(fp, i), _segment(fp, i + 1)) for i in range(SEGMENTS)])).alias("key"))
    flips = [0, *(1 << b for b in range(_WIDTH))]
    turned = fingerprints.select(fp.alias("u"), F.explode(F.array(*[_ring_key(i, _segment(fp, i), _segment(fp, i + 1).bitwiseXOR(F.lit(x))) for i in range(SEGMENTS) for x in flips])).alias("key"))
    start = F.shiftright("key", 2 * _WIDTH)
    third = F.coalesce(*[F.when(start == i, _distance("u", "v", [i, i + 1, i + 2])) for i in range(SEGMENTS)])
    budget = [length * RADIUS // SEGMENTS for length in range(1, SEGMENTS + 1)]
    pairs = turned.join(own, "key").where((F.col("u") < F.col("v")) & (third <= budget[2]) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= budget[3]))
    return pairs.select("u", "v")


def _grouped(distinct: DataFrame) -> DataFrame:
    """Distinct ``fp`` (and other columns) -> also ``component``, a fingerprint that names those that links reach."""
    context = distinct.sparkSession.sparkContext
    spread = distinct.select("fp").repartition(max(context.defaultParallelism, -(-distinct.count() // SPREAD)), "fp")
    found = components(near_links(spread))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fp long, component_id), one row for each row.

    component_id is the smallest doc_id among all documents that links of at most RADIUS bits reach. Null and blank
    texts have fingerprint 0, and are linked like any other. Repeated rows stay; a null doc_id stays null and never
    names a component unless all its documents have none. An empty table gives an empty table. Other columns of
    ``docs`` are neither read nor returned.

    Documents with one fingerprint are folded into one row before any join, so groups of exact copies add nothing to
    the search however large they are; the links found are contracted in the components step.
    """
    marked = settle(docs.select("doc_id", fingerprint("text").alias("fp")))
    group = _grouped(settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"))))
    least = group.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return marked.join(group.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one row of each component: that of the smallest doc_id; columns and their values as they came.

    Of several rows with that doc_id, or in a component without any, the one with the least hash of its columns (maps
    aside) stays. The least row is aggregated by fingerprint before it is by component. Null and blank texts are one
    component; an empty table gives an empty one.

    Texts are read twice and not shuffled unless the list of the rows that go outgrows a broadcast: only hashes of
    rows are compared. Of a row that stays and occurs more than once, its repeats are taken out in a step of their own.
    """
    docs, back = shielded(docs, "_row", "_kept", "fp", "n")
    row = F.xxhash64(*[f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])
    marked = settle(docs.select("doc_id", row.alias("_row"), fingerprint("text").alias("fp")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    group = _grouped(settle(marked.groupBy("fp").agg(first.alias("first"))))
    kept = group.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row"), F.lit(True).alias("_kept"))
    rows = settle(marked.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).join(kept.distinct(), "_row", "left"))
    gone, again = rows.where("_kept is null").select("_row"), rows.where("_kept and n > 1").select("_row")
    own = docs.withColumn("_row", row)
    left_out = gone.unionByName(again)
    out = own.join(F.broadcast(left_out) if left_out.count() <= BROADCAST_ROWS else left_out, "_row", "left_anti")
    if not again.isEmpty():
        out = out.unionByName(own.join(again, "_row", "left_semi").dropDuplicates(["_row"]))
    return out.select(*back)


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
