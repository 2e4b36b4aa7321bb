"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motorfisc.llm.common import NO_WORD, n_words, settle, shielded, table

#: Weights that the sources get in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Size of the mix in sizes of the input; most times that a source's words may occur in it.
SHARE, PASSES = 1.5, 2
#: Output shards (a power of 2).
SHARDS = 16
#: Words of a block. A source is cut into LEAST_BLOCKS at least; of very large ones blocks are longer, so that their
#: number stays below MOST_BLOCKS.
BLOCK_WORDS, LEAST_BLOCKS, MOST_BLOCKS = 1 << 16, 128, 1 << 20
#: Parts of a shard that rows are shuffled within at least; there are more of them the more words the mix has (one part
#: has about CHUNK_WORDS) and the more partitions a shuffle has (DEALT parts of all shards for each).
CHUNKS, CHUNK_WORDS, DEALT = 16, 1 << 22, 8
SEED = 42
#: Slices of a source's permuted order, for prefix sums in parallel: 2 ** SLICE_BITS, or more of them with more
#: documents, so that of evenly spread ones a slice has about SLICE_ROWS at most.
SLICE_BITS, SLICE_ROWS = 10, 1 << 15
#: Sources that a draw goes through one after another: more of them are drawn for as groups first, by hash, so many bits a time.
GROUP, GROUP_BITS = 256, 6


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with ``nth``, their place from 0 in code-point order, null last: numbered in ranges, not in one task."""
    ranged = settle(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("_within", within).join(starts, "_range").withColumn("nth", F.col("_start") + F.col("_within")).drop("_range", "_start", "_within")


def _targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) -> also target: the share of each weight, capped, with the excess reshared by weight.

    A source gets min(cap, level * weight). The level starts from the weights of all; each round caps the sources that
    are above and shares the rest among the others, until none is above.
    """
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    weighed = _ranked(sources).withColumn("weight", F.element_at(weights, (F.pmod("nth", F.lit(len(WEIGHTS))) + 1).cast("int")))
    weighed = settle(weighed.withColumn("cap", PASSES * F.col("source_size").cast("double")))
    goal = SHARE * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, None
    while True:
        above = F.col("cap") < F.lit(level) * F.col("weight")
        n, full, rest = weighed.agg(F.coalesce(F.sum(above.cast("int")), F.lit(0)), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~above, F.col("weight")))).first()
        level = (goal - full) / rest if rest else level
        if n == capped:
            break
        capped = n
    return weighed.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def _ln_factorial(x: str) -> str:
    return f"(CASE WHEN {x} < 2 THEN 0D ELSE ({x} + 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1D / (12 * {x}) - 1D / (360D * {x} * {x} * {x}) END)"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _hypergeometric(rest: str, quota: str, need: str, u: str) -> str:
    """SQL of a draw: of ``need`` blocks drawn from ``rest``, how many belong to the ``quota`` marked ones; u in [0, 1).

    Looked at are the numbers within 12 standard deviations of the mean; what lies beyond is less than doubles tell apart.
    """
    choose = lambda n, k: f"({_ln_factorial(n)} - {_ln_factorial(k)} - {_ln_factorial(f'({n} - {k})')})"
    mean, width = f"{need} * ({quota} / greatest({rest}, 1D))", f"12 * sqrt(mean * greatest(0D, 1 - {quota} / greatest({rest}, 1D))) + 12"
    low = f"greatest(0L, {need} - ({rest} - {quota}), CAST(floor(mean - width) AS BIGINT))"
    high = f"least({need}, {quota}, CAST(ceil(mean + width) AS BIGINT))"
    logs = f"transform(sequence(low, high), k -> {choose(quota, 'k')} + {choose(f'({rest} - {quota})', f'({need} - k)')})"
    parts = _let(logs, "logs", _let("array_max(logs)", "top", "transform(logs, x -> exp(x - top))"))
    total = "aggregate(parts, 0D, (a, x) -> a + x)"
    place = "aggregate(parts, named_struct('sum', 0D, 'at', 0L), (s, x) -> named_struct('sum', s.sum + x, 'at', s.at + CASE WHEN s.sum + x <= goal THEN 1L ELSE 0L END))"
    draw = _let(parts, "parts", _let(f"{total} * {u}", "goal", f"least(high, low + {place}.at)"))
    return _let(mean, "mean", _let(width, "width", _let(low, "low", _let(high, "high", draw))))


def _left(level: int, name: str) -> Column:
    """``need`` blocks drawn from ``items`` of (key, quota) of a ``node``: how many from each."""
    u = f"(pmod(xxhash64({SEED}, {level}, '{name}', node, item.key), 9007199254740992L) / 9007199254740992D)"
    step = _let(_hypergeometric("s.rest", "item.quota", "s.need", u), "k", "named_struct('rest', s.rest - item.quota, 'need', s.need - k, 'left', array_append(s.left, k))")
    start = f"named_struct('rest', {_QUOTAS}, 'need', need, 'left', CAST(array() AS ARRAY<BIGINT>))"
    return F.expr(f"aggregate(items, {start}, (s, item) -> {step}, s -> s.left)")


_QUOTAS = "aggregate(items, 0L, (a, i) -> a + i.quota)"


def _needs(groups: DataFrame, level: int, depth: int) -> DataFrame:
    """(node, g, items) -> (node, g, need): half of each node's blocks, drawn down the prefixes of the groups' hashes."""
    prefix = lambda j: F.shiftrightunsigned(F.col("g"), GROUP_BITS * (depth - j))
    sums = settle(groups.select("node", "g", F.expr(_QUOTAS).alias("quota")))
    need = sums.groupBy("node").agg(F.expr("sum(quota) DIV 2").alias("need")).withColumn("above", F.lit(0).cast("long"))
    for j in range(1, depth + 1):
        own = sums.groupBy("node", prefix(j - 1).alias("above"), prefix(j).alias("key")).agg(F.sum("quota").alias("quota"))
        items = own.groupBy("node", "above").agg(F.array_sort(F.collect_list(F.struct("key", "quota"))).alias("items")).join(need, ["node", "above"])
        drawn = items.select("node", F.explode(F.arrays_zip(F.col("items.key").alias("above"), _left(level, f"group {j}").alias("need"))).alias("d"))
        need = drawn.select("node", "d.*")
    return need.withColumnRenamed("above", "g")


def leaf_quotas(sources: DataFrame) -> DataFrame:
    """(id, quota) -> (id, shard, first, last): the splitting tree, and which ranks of a source's blocks each shard draws.

    Every node holds exact numbers of blocks by source; its halves are a multivariate-hypergeometric draw of half of its
    blocks, and the rest. The leaves are the shards. A shard's draws of a source are ranks of the source's permuted
    blocks that no other has. A draw goes through the sources of a node one after another; where there are more than
    GROUP of them they stand in groups by hash, and what each group has to give is drawn first, down the groups'
    prefixes, so that no draw goes through more than about GROUP sources or 2 ** GROUP_BITS groups.
    """
    n, depth = sources.count(), 0
    while n > GROUP << (GROUP_BITS * depth):
        depth += 1
    group = F.shiftrightunsigned(F.xxhash64("id"), 64 - GROUP_BITS * depth) if depth else F.lit(0).cast("long")
    nodes = sources.groupBy(group.alias("g")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("key"), "quota"))).alias("items")).withColumn("node", F.lit(0).cast("long"))
    for level in range(SHARDS.bit_length() - 1):
        if depth:
            nodes = settle(nodes)
            nodes = nodes.join(_needs(nodes, level, depth), ["node", "g"])
        else:
            nodes = nodes.withColumn("need", F.expr(f"{_QUOTAS} DIV 2"))
        nodes = nodes.withColumn("left", _left(level, "source"))
        half = lambda node, quota: f"named_struct('node', {node}, 'items', transform(items, (x, i) -> named_struct('key', x.key, 'quota', {quota})))"
        nodes = nodes.select("g", F.explode(F.expr(f"array({half('2 * node', 'left[i]')}, {half('2 * node + 1', 'x.quota - left[i]')})")).alias("h")).select("g", "h.node", "h.items")
    leaves = nodes.select(F.col("node").alias("shard"), F.explode("items").alias("i")).select(F.col("i.key").alias("id"), "shard", "i.quota")
    upto = F.sum("quota").over(Window.partitionBy("id").orderBy("shard"))
    return leaves.select("id", "shard", (upto - F.col("quota")).alias("first"), upto.alias("last")).where("last > first")


def _draws(targets: DataFrame) -> DataFrame:
    """(id, source_size, target, blocks) -> (id, pass, block, shard, lo, hi): the blocks that the mix takes.

    A block is a range of word positions in the source's permuted order. The blocks of a pass stand in an order
    permuted by a hash; all of the first pass come before the second. A source's quota is the number of blocks, in that
    order, that hold its target; the tree deals them out, and each shard draws what its leaf says. The last of a
    source's blocks is cut so that the words drawn are the target rounded to whole words.
    """
    # b * source_size / blocks, which as a product could outgrow a long
    edge = lambda b: b * F.expr("source_size div blocks") + F.floor(b * (F.col("source_size") % F.col("blocks")) / F.col("blocks")).cast("long")
    units = targets.select("*", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))).alias("pass")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    units = units.withColumn("lo", edge(F.col("block"))).withColumn("hi", edge(F.col("block") + 1)).where("hi > lo")
    order = Window.partitionBy("id").orderBy("pass", F.xxhash64(F.lit(SEED), "id", "pass", "block"), "block")
    units = units.withColumn("done", F.sum(F.col("hi") - F.col("lo")).over(order) - (F.col("hi") - F.col("lo"))).withColumn("rank", F.row_number().over(order))
    units = settle(units.withColumn("left", F.round("target").cast("long") - F.col("done")).select("id", "pass", "block", "rank", "lo", "hi", "left"))
    leaves = leaf_quotas(units.groupBy("id").agg(F.sum(F.when(F.col("left") > 0, 1).otherwise(0)).cast("long").alias("quota")).where("quota > 0"))
    return units.join(leaves, "id").where("rank > first and rank <= last").select("id", "pass", "block", "shard", "lo", F.least(F.col("hi"), F.col("lo") + F.col("left")).alias("hi"))


_ADDED = ("source_size", "target", "taken", "draws")
_OWN = ("_id", "_null", "_h", "_slice", "_end", "_first", "_blocks", "_drawn")


def sized(docs: DataFrame) -> DataFrame:
    """Documents with ``size``, the words of their text, and ``_salt``, its hash; columns of those names are replaced."""
    return docs.drop("size", "_salt").withColumn("size", n_words(F.col("text"))).withColumn("_salt", F.xxhash64("text"))


def mix(docs: DataFrame) -> DataFrame:
    """Documents with ``size`` (words), ``source_size``, ``target``, ``taken`` and ``draws`` added.

    ``draws`` lists what the mix takes of a row, in the order of passes and words: (shard, pass, first, words),
    ``first`` counting words from 0 within the text; ``taken`` is the sum of its words. Each source's words stand in an
    order permuted by a hash of doc_id and text, and are cut into blocks of equal size; a splitting tree deals the drawn blocks
    out to SHARDS shards, and what it deals is what is taken.

    Null texts have size 0 and nothing is taken of them; a null source is a source of its own, the last; repeated rows
    are rows like any other; an empty table gives an empty one. Columns of ``docs`` pass through, except those with
    names that are added here, which are replaced. Reruns give the same rows.
    """
    return place(sized(docs))


def place(docs: DataFrame) -> DataFrame:
    """``mix`` of documents that are ``sized``."""
    return _placed(docs)[0]


def _placed(docs: DataFrame) -> tuple[DataFrame, float]:
    """``mix`` and the words that it takes, of documents that are ``sized``, of which nothing but that is looked at (and doc_id and source).

    A source's positions come from sums over slices of its order and a window within a slice, so that a source with
    most of the rows is spread over 2 ** SLICE_BITS groups or more, as are rows without a doc_id or of one doc_id (by
    their texts; rows that repeat in both are neighbours in one slice). What is drawn of a slice is joined to its rows by the same
    keys as the window's: rows are shuffled once.
    """
    own = docs.drop(*_ADDED, *_OWN)
    own = own.withColumn("_id", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull())
    bits = max(SLICE_BITS, (docs.count() // SLICE_ROWS).bit_length())
    own = own.withColumn("_h", F.xxhash64(F.lit(SEED), "doc_id", "_salt")).withColumn("_slice", F.shiftright("_h", 64 - bits))
    cell = ["_id", "_null", "_slice"]
    cells = settle(own.groupBy("source", *cell).agg(F.sum("size").alias("words")))
    blocks = F.least(F.lit(MOST_BLOCKS), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS))).cast("long")
    sources = settle(_targets(cells.groupBy("source").agg(F.sum("words").alias("source_size"))).withColumn("blocks", blocks).withColumn("id", F.struct(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"))))
    goal = sources.agg(F.sum("target")).first()[0] or 0.0
    drawn = settle(_draws(sources.select("id", "source_size", "target", "blocks")).select(F.col("id.name").alias("_id"), F.col("id.none").alias("_null"), "block", F.struct("pass", "lo", "hi", "shard").alias("one")))
    # of every slice its first word, and the draws among its words
    running = F.sum("words").over(Window.partitionBy("_id", "_null").orderBy("_slice"))
    cells = cells.withColumn("_first", running - F.col("words")).join(sources.select(F.col("id.name").alias("_id"), F.col("id.none").alias("_null"), "source_size", "target", F.col("blocks").alias("_blocks")), ["_id", "_null"]).drop("source")
    # within one block of the right one, which is looked at as well
    at = lambda x: F.floor(x / F.greatest(F.lit(1), F.col("source_size")) * F.col("_blocks")).cast("long")
    near = cells.where("words > 0").select(*cell, F.explode(F.sequence(F.greatest(F.lit(0), at(F.col("_first")) - 1), F.least(F.col("_blocks"), at(F.col("_first") + F.col("words")) + 1))).alias("block"))
    lists = near.join(drawn, ["_id", "_null", "block"]).groupBy(*cell).agg(F.array_sort(F.collect_list("one")).alias("_drawn"))
    cells = settle(cells.drop("words").join(lists, cell, "left"))
    within = Window.partitionBy(*cell).orderBy("_h", "doc_id", "_salt", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = own.withColumn("_end", F.sum("size").over(within)).join(cells, cell).withColumn("_end", F.col("_end") + F.col("_first"))
    start = "(_end - size)"
    overlaps = f"transform(filter(coalesce(_drawn, array()), b -> b.lo < _end AND b.hi > {start}), b -> named_struct('shard', b.shard, 'pass', b.pass, 'first', greatest(b.lo, {start}) - {start}, 'words', least(b.hi, _end) - greatest(b.lo, {start})))"
    placed = placed.withColumn("draws", F.expr(overlaps))
    return placed.withColumn("taken", F.expr("aggregate(draws, 0L, (a, d) -> a + d.words)")).select(*[c for c in own.columns if c not in (*cell, "_h", "_salt")], "source_size", "target", "taken", "draws"), goal


def chunks_of(words: float, partitions: int) -> int:
    """Parts of a shard of a mix of so many words."""
    return max(CHUNKS, -(-DEALT * partitions // SHARDS), int(-(-words // (SHARDS * CHUNK_WORDS))))


def _chunks(mixed: DataFrame) -> int:
    return chunks_of(mixed.agg(F.sum("taken")).first()[0] or 0, int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """What the mix takes, as documents: a row for each pass over a document, with the columns of ``docs``.

    A text that a pass takes whole stays as it is. Of the others the taken words are kept, joined by spaces. ``n_chars``,
    where there is one, counts the characters of the new text; all other columns keep their values. The rows are laid out
    by shard and shuffled within, as ``laid_out`` does it; a document stays whole and stands in the shard of its first
    draw in the pass. Null and empty texts are taken by no pass; repeated rows are taken like any other; an empty table
    gives an empty one.
    """
    given, back = shielded(docs, "size", "_size", "_draws", "_shard", "_chunk", "_salt", *_ADDED, *_OWN)
    passes = F.expr("filter(transform(sequence(0, %d), i -> filter(draws, d -> d.pass = i)), x -> size(x) > 0)" % (PASSES - 1))
    mixed, goal = _placed(sized(given))
    chunks = chunks_of(goal, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    taken = mixed.select(*given.columns, F.col("size").alias("_size"), F.explode(passes).alias("_draws"))
    taken = _dealt(taken, F.col("_draws")[0], chunks)
    words = F.split(F.regexp_replace("text", f"^{NO_WORD}", ""), NO_WORD)
    some = F.array_join(F.flatten(F.transform("_draws", lambda d: F.slice(words, (d["first"] + 1).cast("int"), d["words"].cast("int")))), " ")
    whole = F.aggregate("_draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]) == F.col("_size")
    out = taken.withColumn("text", F.when(whole, F.col("text")).otherwise(some))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*back)


def _dealt(rows: DataFrame, draw: Column, chunks: int) -> DataFrame:
    """Rows dealt out by the shard of a draw and by chunk, and shuffled within, with ``_shard`` and ``_chunk`` added."""
    order = F.xxhash64(F.lit(SEED), "doc_id", "text", draw["pass"], draw["first"])
    placed = rows.withColumn("_shard", draw["shard"]).withColumn("_chunk", F.pmod(order, F.lit(chunks)))
    return placed.repartition("_shard", "_chunk").sortWithinPartitions("_shard", "_chunk", order)


def laid_out(mixed: DataFrame, chunks: int | None = None) -> DataFrame:
    """The draws of ``mix`` one a row, dealt out by shard and chunk and shuffled within: ready to be written by shard.

    Without ``chunks`` there are as many as the words of the mix and the session's shuffle partitions ask for. Rows of
    which nothing is taken have no draws and so no row; an empty mix gives an empty table.
    """
    chunks = _chunks(mixed) if chunks is None else chunks
    draws = mixed.select("*", F.explode("draws").alias("d")).select(*[c for c in mixed.columns if c != "draws"], "d.*")
    salt = ["text"] if "text" in mixed.columns else []
    order = F.xxhash64(F.lit(SEED), "doc_id", *salt, "pass", "first")
    return draws.withColumn("chunk", F.pmod(order, F.lit(chunks))).repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", order)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of one and a half times all documents takes of each document, and the shards that draw it."""
    docs = settle(sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"))
    return place(docs).select("doc_id", "size", "source_size", "target", "taken", F.array_sort(F.array_distinct("draws.shard")).alias("shards"), "draws")
