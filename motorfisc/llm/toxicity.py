"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from motorfisc.llm.common import bounded_sample, crc_mod, shielded, table

#: Features are hashed into 2 ** HASH_BITS places; the last one is the constant.
HASH_BITS = 20
#: Labelled documents that are learned from at most: those of the least hashes of doc_id.
TRAIN_ROWS = 8_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 5.0, 0.1, 3
_WORDS = regex.compile(r"\p{L}+").findall
_KEPT, _HELD = 100_000, 500_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = zlib.crc32(word.encode("utf-8", "replace"))
        return h


def _features(texts: list[str | None], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every occurrence: words, pairs of neighbours, and pairs with one word between."""
    words = [_WORDS(t.lower()) if t else [] for t in texts]
    flat = np.array([hashes[w] for ws in words for w in ws], dtype=np.uint64)
    if len(hashes) > _KEPT:
        hashes.clear()
    row = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
    rows, features = [row], [flat * np.uint64(0x9E3779B97F4A7C15)]
    for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        same = row[gap:] == row[:-gap]
        rows.append(row[gap:][same])
        features.append((flat[:-gap] * np.uint64(odd) + flat[gap:] * np.uint64(0x27D4EB2F165667C5))[same] * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate(rows), (np.concatenate(features) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _parts(texts: pd.Series) -> Iterator[list[str | None]]:
    held: list[str | None] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t) if t else 0
        if size > _HELD:
            yield held
            held, size = [], 0
    if held:
        yield held


@F.pandas_udf(ArrayType(IntegerType()))
def feature_sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The distinct features of each text, ascending."""
    hashes = _Hashes()
    for batch in batches:
        out: list[np.ndarray] = []
        for texts in _parts(batch):
            row, feature = _features(texts, hashes)
            pairs = np.unique((row << HASH_BITS) | feature)
            cuts = np.searchsorted(pairs >> HASH_BITS, np.arange(1, len(texts)))
            out += np.split((pairs & ((1 << HASH_BITS) - 1)).astype(np.int32), cuts)
        yield pd.Series(out, dtype=object)


def fit(features: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Learns from the rows in their order, EPOCHS times: places and weights, those that are not zero only."""
    size = (1 << HASH_BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for f, y in zip(features, labels, strict=True):
            at = np.append(f, size - 1)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    w = weights(np.arange(size))
    kept = np.flatnonzero(w)
    return kept, w[kept]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Fits on documents with a label: at most ``rows`` ids, whose features are made on the executors.

    ``labels`` are the rows to learn from. Rows without an id or label are left out; of several labels of one id the
    greatest holds. At most ``rows`` feature lists come to the driver.
    """
    named = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(named, rows, "toxicity", "doc_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    got = texts.select("doc_id", "toxic", feature_sets("text").alias("f")).toArrow()
    ids, toxic, lists = got["doc_id"].to_pylist(), got["toxic"].to_pylist(), got["f"].combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i]))
    return fit([flat[ends[i] : ends[i + 1]] for i in order], [int(toxic[i] > 0) for i in order])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5) added; columns of those names are replaced.

    A feature counts once a text, however often it occurs. Null and empty texts get the score of the constant alone.
    Only the text is looked at, whole. Repeated rows get the same score; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.zeros((1 << HASH_BITS) + 1)
        dense[shared.value[0]] = shared.value[1]
        hashes = _Hashes()
        for batch in batches:
            out = []
            for texts in _parts(batch):
                row, feature = _features(texts, hashes)
                hit = dense[feature] != 0
                pairs = np.unique((row[hit] << HASH_BITS) | feature[hit])
                total = np.bincount(pairs >> HASH_BITS, dense[pairs & ((1 << HASH_BITS) - 1)], minlength=len(texts)) + dense[-1]
                out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.drop("score", "predicted").withColumn("score", scored("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def training_rows(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: all but the held-out fifth."""
    return labels.where(crc_mod(F.col("doc_id"), 5) != 0)


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The documents that are not predicted toxic; columns and their values as they came.

    A model without weights (no label, or too few for any weight) can't reject: all documents stay.
    """
    if not len(model[0]):
        return docs
    given, back = shielded(docs, "score", "predicted")
    return score(given, model).where("predicted = 0").select(*back)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, training_rows(table(spark, sf_dir, "labels")))
    return score(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
