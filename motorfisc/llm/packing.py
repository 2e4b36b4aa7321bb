"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorfisc.llm.common import table
from motorfisc.llm.tokens import VOCABULARY, merges

#: Permitted sequence lengths in tokens, ascending, and what a sequence costs beside its length.
CAPACITIES = (512, 1024, 2048)
OVERHEAD = 64
#: Pieces, and characters of theirs, that are packed together at most; a partition with more is packed in several rounds.
WINDOW, WINDOW_CHARS = 1 << 16, 1 << 21
_OUT = 4096
_SCHEMA = "doc_id long, no_id boolean, n_tokens long, piece long, text string, tokens long, bin_id long, capacity int, bin_offset int"


def cost(capacity: int) -> int:
    return capacity + OVERHEAD


def best_fit(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs pieces of 1 to max(capacities) tokens: the bin, offset and bin's capacity of each.

    Pieces are taken longest first (ties: in their order). A piece goes to the open bin that it leaves with the least
    room. If none fits, a bin is opened whose cost for the tokens it can expect is least: the piece, and as much as there
    is left of pieces that fit beside it. At the end each bin is downsized to the smallest permitted length that holds
    its contents.
    """
    most = capacities[-1]
    order = np.argsort(-sizes, kind="stable")
    volume = np.cumsum(np.bincount(sizes, minlength=most + 1) * np.arange(most + 1)).tolist()  # of pieces up to a size
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    used: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(most + 1)]
    rooms, left = 0, int(sizes.sum())  # rooms: bit r is set if a bin has room r
    for i in order.tolist():
        size = int(sizes[i])
        left -= size
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            # pieces still to come are no longer than this one
            room = min((c for c in capacities if c >= size), key=lambda c: (cost(c) / (size + min(c - size, left, volume[min(c - size, size)])), c))
            chosen = len(used)
            used.append(0)
        bins[i], offsets[i] = chosen, used[chosen]
        used[chosen] += size
        if room > size:
            if not by_room[room - size]:
                rooms |= 1 << (room - size)
            by_room[room - size].append(chosen)
    held = np.array(used, dtype=np.int64)
    return bins, offsets, np.array(capacities)[np.searchsorted(capacities, held)][bins] if len(held) else held


def _placed(rows: list[tuple], capacities: tuple[int, ...], first_bin: int) -> pd.DataFrame:
    """Pieces (doc_id, no_id, n_tokens, piece, text, tokens) with their bins, in the order of bins and offsets."""
    out = pd.DataFrame(rows, columns=_SCHEMA_NAMES[:6])
    sizes, most = out["tokens"].to_numpy(dtype=np.int64), capacities[-1]
    bin_, offset, capacity = np.full(len(out), -1), np.zeros(len(out), dtype=np.int64), np.full(len(out), most)
    full, part = sizes == most, (sizes > 0) & (sizes < most)
    bin_[full] = np.arange(full.sum())
    b, offset[part], capacity[part] = best_fit(sizes[part], capacities)
    bin_[part] = b + full.sum()
    for name, x, kind in (("bin_id", bin_ + first_bin, "Int64"), ("capacity", capacity, "Int32"), ("bin_offset", offset, "Int32")):
        out[name] = pd.Series(x).astype(kind).mask(bin_ < 0)
    return out.iloc[np.lexsort((offset, bin_))]


_SCHEMA_NAMES = [c.split(" ")[0] for c in _SCHEMA.split(", ")]


def _packer(capacities: tuple[int, ...], path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, model = TaskContext.get(), merges(path)
        next_bin = (context.partitionId() if context else 0) << 40
        held: list[tuple] = []
        chars = 0
        for batch in _and_end(batches):
            if batch is not None:
                for at in range(0, len(batch), 512):
                    part = batch.iloc[at : at + 512]
                    for doc_id, no_id, pieces in zip(part["doc_id"], part["no_id"], model.cut(part["text"].to_list(), capacities[-1]), strict=True):
                        total = sum(n for _, n in pieces)
                        held += [(doc_id, no_id, total, i, text, n) for i, (text, n) in enumerate(pieces or [("", 0)])]
                        chars += sum(len(text) for text, _ in pieces)
            if held and (batch is None or len(held) >= WINDOW or chars >= WINDOW_CHARS):
                out = _placed(held, capacities, next_bin)
                next_bin += int(out["tokens"].gt(0).sum())
                held, chars = [], 0
                for at in range(0, len(out), _OUT):
                    yield out.iloc[at : at + _OUT]

    return run


def _and_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) -> one row for each piece of a document: its text, and where it stands in which sequence.

    Columns: doc_id, n_tokens (of the document), piece (from 0), text and tokens (of the piece), bin_id, capacity (of
    the bin, one of ``capacities``) and bin_offset, in tokens. A document of more tokens than the longest capacity is
    cut between pre-tokens into pieces that fit. The pieces of a document, in order, make up its text; every piece with
    a token is in exactly one bin, no bin holds more than its capacity, and bin ids are unique. A document without
    tokens (or with a null text) has one row with an empty text, 0 tokens and no bin. Repeated rows are packed one by
    one; an empty table gives an empty one. Other columns are neither read nor returned. Within a partition rows stand
    in the order of bins and offsets, so that what is written holds its sequences one after another.

    Each partition packs its own documents, in rounds of WINDOW pieces or WINDOW_CHARS characters, so nothing is
    shuffled, no key can be hot and a lost task packs its partition again with the same result. Another split of the
    input gives other bins; what that wastes is a part of the last bins of each round.
    """
    doc_id = F.col("doc_id").cast("long")  # pandas would turn longs with nulls among them into doubles
    given = docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id"), "text")
    placed = given.mapInPandas(_packer(tuple(sorted(capacities)), path), _SCHEMA)
    return placed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def op9_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 512, 1024 or 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
