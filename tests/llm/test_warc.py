import gzip
import hashlib
from collections import defaultdict
from pathlib import Path

import pytest
from motorfisc.llm import warc

HTML = "<html><body>" + "word " * 300 + "</body></html>"
ROWS = [
    (1, "http://a/1", HTML), (2, "http://a/2", HTML), (5, "http://a/5", HTML), (5, "http://b/5", HTML), (None, "http://a/none", HTML),
    (7, None, "short"), (8, "http://a/8", "short"), (9, "", None), (10, "http://a/10\r\nWARC-Type: metadata", ""),
    (11, "http://é/11 x", "é" * 500), (12, "u", "é" * 500), (13, "u", "é" * 499 + "x"), (14, "u", "é" * 499 + "x"),
    (15, "u", f"{warc.VERSION}\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" * 60), (16, "u", "\r\n\r\n" * 400), (17, "u", "\n" * 1500 + "\r"),
    (18, "u", "\r\n\r\n" * 400), (None, "u", "nobody " * 200), (None, "v", "nobody " * 200), (20, "u", "z" * 400_000),
]


def plain(rows):
    same = defaultdict(list)
    for page_id, _, html in rows:
        same[(html or "").encode()].append(page_id)
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        most = max((i for i in same[payload] if i is not None), default=None) if len(payload) >= 1000 else None
        again = most is not None and page_id != most
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", most if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pages = spark.createDataFrame([(*r, "x", b"y") for r in ROWS], "page_id int, url string, html string, digest string, payload binary").repartition(3)
    out = tmp_path_factory.mktemp("warc")
    warc.write(warc.records_of(pages), f"file://{out}/crawl")
    warc.write(warc.deduplicated(warc.read(spark, f"{out}/crawl", whole=True), warc.read(spark, f"{out}/crawl")), f"{out}/deduplicated")
    return out


def plain_records(path):
    """Records of gzipped archives by a reader of their own, which goes by Content-Length only."""
    for file in sorted(Path(path).glob("*.gz")):
        data, at = gzip.decompress(file.read_bytes()), 0
        while at < len(data):
            stop = data.index(b"\r\n\r\n", at)
            head = data[at:stop].decode().split("\r\n")
            assert head[0] == warc.VERSION
            fields = dict(x.split(": ", 1) for x in head[1:])
            begin, at = stop + 4, stop + 4 + int(fields["Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            yield fields, data[begin:at]
            at += 4


def test_archives_are_well_formed_and_hold_every_payload(folder):
    crawl = list(plain_records(folder / "crawl"))
    assert sorted(b.partition(b"\r\n\r\n")[2] for _, b in crawl) == sorted((r[2] or "").encode() for r in ROWS)
    assert {f["WARC-Type"] for f, _ in crawl} == {"response"}
    kept = list(plain_records(folder / "deduplicated"))
    ids = {f["WARC-Record-ID"]: f for f, _ in kept}
    assert len(kept) == len(ROWS) and not ids.keys() & {f["WARC-Record-ID"] for f, _ in crawl}
    for f, block in kept:
        if f["WARC-Type"] == "revisit":
            of = ids[f["WARC-Refers-To"]]
            assert f["WARC-Profile"] == warc.PROFILE and block.endswith(b"\r\n\r\n") and of["WARC-Type"] == "response" and of["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
        else:
            assert "WARC-Refers-To" not in f and hashlib.sha1(block.partition(b"\r\n\r\n")[2]).hexdigest() == f["WARC-Payload-Digest"].removeprefix("sha1:")


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_reading_gives_the_records_back_however_lines_come(spark, folder, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = warc.read(spark, str(folder / "crawl"), whole=True).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((str(r.page_id), bytes(r.payload)) for r in got) == sorted((str(r[0]), (r[2] or "").encode()) for r in ROWS)
    assert all(bytes(r.digest) == hashlib.sha1(r.payload).digest() and r.payload_bytes == len(r.payload) for r in got)
    assert {r.uri for r in got} >= {None, "", "http://a/10 WARC-Type: metadata", "http://é/11 x"}


def test_revisits_are_resolved(spark, folder):
    got = warc.resolved(warc.read(spark, str(folder / "deduplicated"))).collect()
    assert sorted(((r.page_id, r.payload_bytes, bytes(r.digest).hex(), r.record_type, r.refers_to) for r in got), key=repr) == plain(ROWS)


def test_a_broken_archive_raises_and_other_blocks_are_read(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nContent-Length: 6\r\n\r\n\xff\xfe\r\n\r\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(gzip.compress(record + b"\r\n\r\n") + gzip.compress(record + b"\r\n\r\n"))
    got = warc.read(spark, str(tmp_path / "a"), whole=True).collect()
    assert [(bytes(r.payload), r.record_type, r.page_id) for r in got] == [(b"\xff\xfe\r\n\r\n", "resource", None)] * 2
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc.gz").write_bytes(gzip.compress(record[:-3]))
    with pytest.raises(Exception, match="ends within a record"):
        warc.read(spark, str(tmp_path / "b")).collect()


def test_shuffled_digests_and_empty_tables(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    warc.write(warc.deduplicated(warc.read(spark, str(folder / "crawl"), whole=True), warc.read(spark, str(folder / "crawl"))), str(tmp_path / "d"))
    got = warc.resolved(warc.read(spark, str(tmp_path / "d"))).collect()
    assert sorted(((r.page_id, r.payload_bytes, bytes(r.digest).hex(), r.record_type, r.refers_to) for r in got), key=repr) == plain(ROWS)
    warc.write(warc.records_of(spark.createDataFrame([], "page_id long, url string, html string")), str(tmp_path / "e"))
    assert warc.resolved(warc.read(spark, str(tmp_path / "e"))).collect() == []


def test_query_equals_the_plain_contract_on_a_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.op13_warc_revisits(spark, sf_dir).collect()), key=repr) == plain(rows)
