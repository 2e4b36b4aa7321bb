import random

import pytest
import xxhash

from motorfisc.llm import simhash
from motorfisc.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "a b c", "É É é x\x0by\x0cz", "the cat sat on the mat " * 300, "a" * 5000])
def test_fingerprint_is_the_plain_one(text):
    assert simhash.simhash(text) & (2**64 - 1) == plain_fingerprint(text)


def test_fingerprint_agrees_with_the_engines_hash(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_links_are_all_pairs_within_the_radius(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:40]:
        for n in (1, 2, 3, 4):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    got = {frozenset(r) for r in simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long")).distinct().collect()}
    want = {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and want


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3), (7, 6), (6, 7)]
    got = dict(components(spark.createDataFrame(links, "u long, v long")).collect())
    want = {i: 10 for i in range(10, 41)} | {i: 100 for i in range(100, 160)} | {6: 6, 7: 6}
    assert got == want


def test_near_duplicates_with_nulls_ties_and_clashing_columns(spark):
    long = "some words that make a text of its own number " * 30
    rows = [(3, long, "x"), (1, long, "y"), (1, long, "y"), (9, None, None), (8, " ", None), (None, long, "z"), (7, "quite another text", "w"), (6, "quite another text indeed so", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([("3", 1), ("1", 1), ("1", 1), ("None", 1), ("9", 8), ("8", 8), ("7", 7), ("6", 6)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 6, 7, 8]


@pytest.mark.parametrize("broadcast", [True, False])
def test_one_row_of_each_component_stays_without_ids_and_with_repeated_ones(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    a, b, d, e = ("alpha beta gamma delta " * 20, "one two three four five six " * 20, "red green blue black white " * 20, "north south east west up down " * 20)
    rows = [(None, a), (None, b), (None, b), (None, None), (5, d), (5, e), (5, e), (9, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(simhash.keep_one(docs).collect(), key=str)
    assert got == sorted([(None, a), (None, b), (None, None), (5, d), (5, e)], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == [] and simhash.keep_one(docs).collect() == []


def test_query_is_brute_force(spark, sf_dir):
    rows = simhash.op1_simhash_dedup(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{f:016x}" for d, f in fps.items()}
    group = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if group[b] < group[a] and (fps[a] ^ fps[b]).bit_count() <= 3:
                    group[a], changed = group[b], True
    assert {r.doc_id: r.component_id for r in rows} == group
