"""WARC archives: records written and read by Spark, and revisit records resolved by payload digest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorfisc.llm.common import checkpoint_folder, settle, table

#: Payloads of so many bytes or more are written once.
LEAST_BYTES = 1000
#: Digests of repeated payloads (20 bytes each) that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
#: Fixed values of the format: line end, version, and the profile of revisits by payload.
_CRLF, VERSION = "\r\n", "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_HEADERS = "record_id string, record_type string, uri string, date string, page_id long, digest binary, payload_bytes long, refers_to_id string"
#: Records of a batch that is given on at most, and bytes of their payloads.
_OUT, _OUT_BYTES = 2048, 1 << 24


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; white space in a value becomes a space, so that no value starts a line of its own."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\x00-\x20]+", " "), F.lit(_CRLF)), F.lit(""))


def record_id(*parts: Column) -> Column:
    """A urn:uuid made of the parts' SHA-256, the same in every run."""
    h = F.sha2(F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> one response record for each row: _HEADERS and ``payload``, the html in UTF-8 (null: empty)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("uri"), payload.alias("payload"))
    digest = F.unhex(F.sha1("payload"))
    made = given.withColumn("digest", digest).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    none = F.lit(None).cast("string")
    return made.select(record_id(F.col("page_id"), F.col("uri"), F.hex("digest")).alias("record_id"), F.lit("response").alias("record_type"), "uri", F.lit("2000-01-01T00:00:00Z").alias("date"), "page_id", "digest", "payload_bytes", none.alias("refers_to_id"), "payload")


def write(records: DataFrame, path: str) -> None:
    """Writes records as gzipped WARC files under ``path``, a file for each partition.

    A response's block is an HTTP response with the payload; a revisit's has the HTTP headers only. Each record ends in
    two line ends, which are what the writer puts between rows.
    """
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2))
    block = F.concat(http.cast("binary"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit(f"{VERSION}{_CRLF}"),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", F.col("record_id")),
        _field("WARC-Date", F.col("date")),
        _field("WARC-Target-URI", F.col("uri")),
        _field("WARC-Page-ID", F.col("page_id")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.lower(F.hex("digest")))),
        _field("WARC-Payload-Length", F.col("payload_bytes")),
        _field("WARC-Refers-To", F.col("refers_to_id")),
        _field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit(f"Content-Type: application/http;msgtype=response{_CRLF}"),
        _field("Content-Length", F.octet_length("_block")),
        F.lit(_CRLF),
    )
    rows = records.withColumn("_block", block).select(F.concat(head.cast("binary"), "_block").cast("string").alias("value"))
    rows.write.option("lineSep", _END.decode()).option("compression", "gzip").text(path)


def _parse(stream: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """The header fields of the record at ``at`` and where its block begins and ends, or None if the stream doesn't hold it whole."""
    while stream[at : at + 2] == b"\r\n":
        at += 2
    stop = stream.find(_END, at)
    if stop < 0:
        return None
    lines = stream[at:stop].decode("utf-8", "replace").split(_CRLF)
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    begin = stop + len(_END)
    end = begin + int(fields["content-length"])
    return (fields, begin, end) if end <= len(stream) else None


def _whole(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


class _Out:
    """Records read, held until they make a batch; ``whole``: with their payloads."""

    def __init__(self, schema: pa.Schema, whole: bool) -> None:
        self.schema, self.whole, self.rows, self.size = schema, whole, [], 0

    def add(self, fields: dict[str, str], block: bytes) -> None:
        kind = fields.get("warc-type")
        payload = block
        if "application/http" in fields.get("content-type", ""):
            payload = block.partition(_END)[2]
        if kind == "revisit":
            # nothing of the payload is there; what is known of it says the record that has it
            told = fields.get("warc-payload-digest", "").rpartition(":")[2]
            digest, n = bytes.fromhex(told) if len(told) == 40 else None, _whole(fields.get("warc-payload-length"))
        else:
            digest, n = hashlib.sha1(payload).digest(), len(payload)
        head = (fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), _whole(fields.get("warc-page-id")), digest, n, fields.get("warc-refers-to"))
        self.rows.append((*head, payload) if self.whole else head)
        self.size += len(payload) if self.whole else 0

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*self.rows, strict=True) if self.rows else [[]] * len(self.schema), self.schema, strict=True)], schema=self.schema)
        self.rows, self.size = [], 0
        return out


def _reader(whole: bool):
    """Lines of archives, file after file and in order -> their records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [pa.field(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split(" ") for c in _HEADERS.split(", "))]
        out = _Out(pa.schema([*names, pa.field("payload", pa.binary())] if whole else names), whole)
        held, size, need, now = [], 0, 0, None

        def ended() -> None:
            if b"".join(held).strip():
                raise ValueError("an archive ends within a record")

        for batch in batches:
            files, lines = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            cuts = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1).tolist(), len(lines)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if files[a] != now:
                    ended()
                    held, size, need, now = [], 0, 0, files[a]
                held.append(b"\n".join(lines[a:b]) + b"\n")
                size += len(held[-1])
                if size < need:
                    continue
                stream, at, need = b"".join(held), 0, 0
                while found := _parse(stream, at):
                    fields, begin, at = found
                    out.add(fields, stream[begin:at])
                    if len(out.rows) >= _OUT or out.size >= _OUT_BYTES:
                        yield out.batch()
                held = [stream[at:]]
                size = len(held[0])
                need = 2 * size  # a long record is looked at again when there is twice as much of it
            if out.rows:
                yield out.batch()
        # of the last record there may be less than need was set to
        stream, at = b"".join(held), 0
        while found := _parse(stream, at):
            fields, begin, at = found
            out.add(fields, stream[begin:at])
        held = [stream[at:]]
        ended()
        if out.rows:
            yield out.batch()

    return run


def read(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Archives (*.gz) under ``path`` -> their records: _HEADERS, with ``whole`` also ``payload``.

    Spark reads lines, and a file that is gzipped isn't cut, so each is one task's work, in order; records are put
    together again by their Content-Length, whatever lines a payload holds. Of a response the payload's digest and
    length are taken from the payload itself, of a revisit from its headers. A task holds a batch of lines and the
    record that it is at. A record that an archive breaks off in raises.
    """
    lines = spark.read.option("lineSep", "\n").text(path, pathGlobFilter="*.gz").select(F.xxhash64(F.input_file_name()).alias("file"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_reader(whole), _HEADERS + (", payload binary" if whole else ""))


def _repeated(headers: DataFrame) -> DataFrame:
    """(digest, payload_bytes) of the payloads that are written once, with the page that has them: that of the largest page_id.

    Digests are counted in the tasks that have them before they are shuffled, so a payload that is everywhere is no hot key.
    """
    found = headers.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("digest", "payload_bytes")
    best = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id")))
    return found.agg(F.count(F.lit(1)).alias("n"), best.alias("best")).where("n > 1 and best is not null").select("digest", "payload_bytes", F.col("best.page_id").alias("first_page"), F.col("best.record_id").alias("first_id"))


def deduplicated(records: DataFrame, headers: DataFrame) -> DataFrame:
    """Records with payloads, and the headers of all of them -> the records with fresh headers, repeats made revisits.

    Of the records with one payload of LEAST_BYTES or more that of the largest page_id stays a response, as does any
    other row of that page_id; the others become revisits that refer to it and carry no payload. Shorter payloads stay
    where they are. Records without a page_id are never referred to while another has their payload; if none has a
    page_id all stay. What is decided by digest is joined to the records by digest; where it outgrows a broadcast the
    join is a shuffle, whose hot digests adaptive execution splits.
    """
    first = settle(_repeated(headers))
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first
    joined = records.join(first, ["digest", "payload_bytes"], "left")
    again = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    fresh = record_id(F.lit("deduplicated"), F.col("record_id"))
    of = record_id(F.lit("deduplicated"), F.col("first_id"))
    kept = joined.withColumn("_again", again)
    return kept.select(fresh.alias("record_id"), F.when(F.col("_again"), "revisit").otherwise("response").alias("record_type"), "uri", "date", "page_id", "digest", "payload_bytes", F.when(F.col("_again"), of).alias("refers_to_id"), F.when(~F.col("_again"), F.col("payload")).alias("payload"))


def resolved(headers: DataFrame) -> DataFrame:
    """Headers of a deduplicated archive -> the same with ``refers_to``, the page_id of the response that a revisit stands for.

    Revisits are joined to the responses by payload digest; of several responses with one payload that of the largest
    page_id is meant. A revisit whose payload no record of the archive has gets null, as does a response.
    """
    revisits = headers.where("record_type = 'revisit'")
    wanted = headers.where("record_type = 'response'").groupBy("digest").agg(F.max("page_id").alias("refers_to"))
    found = revisits.join(wanted, "digest", "left").select(*headers.columns, "refers_to")
    return headers.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(found)


def op13_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as an archive, that archive deduplicated, and what reading it back tells of every page."""
    folder = f"{checkpoint_folder(spark)}/warc-{uuid4().hex}"
    write(records_of(table(spark, sf_dir, "pages")), f"{folder}/crawl")
    write(deduplicated(read(spark, f"{folder}/crawl", whole=True), read(spark, f"{folder}/crawl")), f"{folder}/deduplicated")
    back = resolved(settle(read(spark, f"{folder}/deduplicated")))
    return back.select("page_id", "payload_bytes", F.lower(F.hex("digest")).alias("payload_digest"), "record_type", "refers_to")


#: The same without archives.
ORACLE = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first_page FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first_page IS NULL OR page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_page IS NULL OR page_id = first_page THEN NULL ELSE first_page END AS refers_to FROM f
"""
