"""Tables that are written in versions: a version is there as soon as its commit is, and a batch is put in once."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


class Outrun(RuntimeError):
    """Another writer has committed the version that this one was about to."""


@dataclass(frozen=True)
class Version:
    """A committed state: its number, the folders of its parts under the table's path, and each writer's last batch."""

    number: int
    parts: dict[str, str]
    batches: dict[str, int] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    """The file system of a path, whichever store it is in, and the class of its paths."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _numbers(spark: SparkSession, path: str) -> list[int]:
    store, hadoop = _files(spark, path)
    folder = hadoop.Path(f"{path}/commits")
    if not store.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in store.listStatus(folder) if s.getPath().getName().isdigit())


def _load(spark: SparkSession, path: str, number: int) -> Version:
    store, hadoop = _files(spark, path)
    stream = store.open(hadoop.Path(f"{path}/commits/{number:020d}"))
    try:
        told = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    return Version(number, told["parts"], told["batches"])


def latest(spark: SparkSession, path: str) -> Version | None:
    """The newest committed version, or None where nothing was committed; what a dead write left behind doesn't count."""
    numbers = _numbers(spark, path)
    return _load(spark, path, numbers[-1]) if numbers else None


def read(spark: SparkSession, path: str, part: str = "rows", number: int | None = None) -> DataFrame | None:
    """A part of the newest version, or of an older one by its number; None where nothing was committed."""
    version = latest(spark, path) if number is None else _load(spark, path, number)
    return None if version is None else spark.read.parquet(f"{path}/{version.parts[part]}")


def _publish(spark: SparkSession, path: str, version: Version) -> None:
    """The commit is written beside its place and renamed into it, which fails where there is one: of two writers one wins."""
    store, hadoop = _files(spark, path)
    place, aside = hadoop.Path(f"{path}/commits/{version.number:020d}"), hadoop.Path(f"{path}/commits/_{uuid4().hex}")
    stream = store.create(aside, False)
    stream.write(bytearray(json.dumps({"parts": version.parts, "batches": version.batches}, sort_keys=True).encode()))
    stream.close()
    context = hadoop.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    renames = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(store.makeQualified(aside), store.makeQualified(place), renames)
    except Exception as why:
        store.delete(aside, False)
        if "FileAlreadyExists" in str(why):
            raise Outrun(f"version {version.number} of {path} was committed by another writer") from why
        raise


def commit(spark: SparkSession, path: str, make: Callable[[Callable[[str], DataFrame | None]], dict[str, DataFrame]], writer: str, batch: int) -> bool:
    """Writes a new version and then its commit; False where the writer's batch is in the table already.

    ``make`` gets a function that reads a part of the version before (None: there is none) and returns the new parts.
    All parts become visible at once, by the commit, which is written last: a write that dies before leaves the table as
    it was, and a batch that comes again, or under an older number, changes nothing. Versions are numbered by the table,
    not by the writer, so a query that starts anew under a new name goes on where the table is.
    """
    before = latest(spark, path)
    batches = dict(before.batches) if before else {}
    if batches.get(writer, -1) >= batch:
        return False
    number = before.number + 1 if before else 0
    old = lambda part: spark.read.parquet(f"{path}/{before.parts[part]}") if before and part in before.parts else None
    folder, parts = f"data/{number:020d}-{uuid4().hex}", dict(before.parts) if before else {}
    for part, rows in make(old).items():
        rows.write.parquet(f"{path}/{folder}/{part}")
        parts[part] = f"{folder}/{part}"
    _publish(spark, path, Version(number, parts, batches | {writer: batch}))
    return True


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes all but the newest ``keep`` versions and what dead writes left; no write may be under way. Returns the folders that went."""
    store, hadoop = _files(spark, path)
    numbers = _numbers(spark, path)
    kept, gone = numbers[-keep:], 0
    used = {f.split("/")[1] for n in kept for f in _load(spark, path, n).parts.values()}
    for n in numbers[:-keep]:
        store.delete(hadoop.Path(f"{path}/commits/{n:020d}"), False)
    data = hadoop.Path(f"{path}/data")
    for status in store.listStatus(data) if store.exists(data) else []:
        if status.getPath().getName() not in used:
            store.delete(status.getPath(), True)
            gone += 1
    return gone
