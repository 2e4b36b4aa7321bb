"""Sharding into contiguous runs of groups with the smallest feasible capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorfisc.llm.common import settle, table

SHARDS = 16
#: Atomic groups are the texts of one hash range, in the order of the hash: 2 ** GROUP_BITS ranges at most.
GROUP_BITS = 16
#: A group with more than so many times the mean rows of a group is numbered in several parts.
SPLIT = 4


def _runs(sizes: list[int], level: int) -> list[int]:
    """First places of the fewest runs of at most ``level`` bytes; a larger group is a run of its own."""
    starts, room = [0], level
    for i, size in enumerate(sizes):
        if size > room and i > starts[-1]:
            starts.append(i)
            room = level
        room -= size
    return starts


def _smallest(sizes: list[int], shards: int, low: int, high: int) -> int:
    """The smallest level with which there are at most ``shards`` runs; ``high`` is known to do."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if len(_runs(sizes, middle)) <= shards else (middle + 1, high)
    return high


def _even(sizes: list[int], shards: int, level: int) -> list[int]:
    """First places of exactly ``shards`` runs of at most ``level`` bytes, each cut nearest to its share of the rest.

    A run ends early only where the runs left can take what remains: ``bound[n]`` is the first place from which n do.
    """
    bound, held = [len(sizes)], 0
    for i in range(len(sizes) - 1, -1, -1):
        if held + sizes[i] > level:
            bound.append(i + 1)
            held = 0
        held += sizes[i]
    starts, left, rest, held = [0], shards, sum(sizes), 0
    for i, size in enumerate(sizes):
        if left > 1 and i > starts[-1]:
            can = left - 1 >= len(bound) or i >= bound[left - 1]
            if held + size > level or can and (len(sizes) - i < left or (2 * held + size) * left > 2 * rest):
                starts.append(i)
                left, rest, held = left - 1, rest - held, 0
        held += size
    return starts


def _places(sizes: list[int], shards: int) -> list[int]:
    """First places of the shards, as many as there are or as groups allow.

    The level is the smallest one to which shards need be filled, those of a single larger (hot) group aside. Hot groups
    part the others into stretches. A stretch gets the shards that it needs at that level, and those left over go where
    a shard has most bytes; then each stretch is cut evenly.
    """
    if len(sizes) <= shards:
        return list(range(len(sizes)))
    level = _smallest(sizes, shards, 1, sum(sizes))
    edges = sorted({0, len(sizes)} | {p for i, size in enumerate(sizes) if size > level for p in (i, i + 1)})
    stretches = [[a, sizes[a:b]] for a, b in zip(edges, edges[1:], strict=False)]
    counts = [len(_runs(own, level)) for _, own in stretches]
    for _ in range(shards - sum(counts)):
        at = max((i for i, (_, own) in enumerate(stretches) if len(own) > counts[i]), key=lambda i: sum(stretches[i][1]) / counts[i])
        counts[at] += 1
    return [a + p for (a, own), n in zip(stretches, counts, strict=True) for p in (_even(own, n, level) if len(own) > 1 else [0])]


def _cuts(groups: DataFrame, shards: int) -> DataFrame:
    """(g, bytes) of ordered groups -> one row: capacity, and ``ends``, the last g of each shard but the last.

    The capacity is the smallest one with which a greedy walk over the ordered groups opens at most ``shards`` shards,
    found by binary search; no shard has more. Under it the shards are cut evenly. The walks are over a list of group
    sizes, which has 2 ** GROUP_BITS entries at most, whatever the input.
    """
    rows = sorted(groups.select("g", "bytes").collect())
    sizes = [r[1] for r in rows]
    least = max([*sizes, -(-sum(sizes) // shards)])
    capacity = _smallest(sizes, shards, least, least + max([0, *sizes]))
    ends = [rows[i - 1][0] for i in _places(sizes, shards)[1:]]
    return groups.sparkSession.range(1).select(F.lit(capacity).cast("long").alias("capacity"), F.array(*[F.lit(g) for g in ends]).cast("array<int>").alias("ends"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, text) -> (doc_id, size, text_crc32, shard, slot), one row for each row.

    Size is the text's UTF-8 bytes plus 1, a null text having no bytes (and a null text_crc32). Equal texts share a
    hash, hence a group, hence a shard. Groups stand in the order of their hash and are cut by ``_cuts``, so that the
    largest shard is as small as it can be for that order and the others are as even as a hot text allows. Slots count
    from 0 without gaps in each shard, in the order of group and doc_id; which of two rows with the same doc_id and text
    comes first doesn't show. An empty table gives an empty one. Other columns of ``docs`` are neither read nor returned.

    Slots of one shard are not counted in one task: rows are counted by part of a group, the counts are summed up over
    the parts, and rows are numbered within a part. A group with very many rows (a hot text) is split into parts by a
    hash of doc_id (by place, without one). Texts are read once. Both tables that are broadcast have a row for each group or part: at most 2 ** GROUP_BITS groups,
    and (1 + 1 / SPLIT) times as many parts.
    """
    raw = F.coalesce(F.col("text"), F.lit(""))
    spread = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), F.monotonically_increasing_id())
    rows = settle(docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.shiftright(F.xxhash64("text"), 64 - GROUP_BITS).cast("int").alias("g"), spread.alias("spread")))
    groups = settle(rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    cuts = _cuts(groups, shards)
    mean = groups.agg(F.greatest(F.lit(1.0), F.avg("n")).alias("mean"))
    shard_of = F.size(F.filter("ends", lambda e: e < F.col("g")))
    placed = groups.join(F.broadcast(cuts.join(F.broadcast(mean))), F.lit(True)).select("g", shard_of.alias("shard"), F.ceil(F.col("n") / (SPLIT * F.col("mean"))).cast("int").alias("parts"))
    placed = settle(placed)
    parted = rows.join(F.broadcast(placed), "g").withColumn("part", F.pmod("spread", F.col("parts")).cast("int"))
    counts = parted.groupBy("shard", "g", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("shard").orderBy("g", "part").rowsBetween(Window.unboundedPreceding, 0))
    firsts = settle(counts.select("g", "part", (upto - F.col("n")).alias("first")))
    nth = F.row_number().over(Window.partitionBy("g", "part").orderBy("doc_id", "text_crc32", "size"))
    numbered = parted.withColumn("nth", nth).join(F.broadcast(firsts), ["g", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"))


def op5_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by the law ``bytes``."""
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
