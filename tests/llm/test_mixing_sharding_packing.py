import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motorfisc.llm import mixing, packing, sharding
from motorfisc.llm.common import n_words

DOCS = "doc_id long, source string, text string, size string, draws string"


def words(n):
    return " ".join(f"w{i}" for i in range(n))


@pytest.fixture(scope="module")
def mixed_input(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"s{i % 4}" if i % 9 else None, words(int(rng.integers(0, 60))), "clash", "clash") for i in range(300)]
    rows += [(1000, "s1", words(2500), "a", "b"), (1001, "s2", None, "a", "b"), (1001, "s2", None, "a", "b"), (None, "s3", "x y", "a", "b"), (1002, "empty", " \n", "a", "b")]
    return spark.createDataFrame(rows, DOCS)


def resharded(sizes):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return share | {s: 2.0 * sizes[s] for s in full}
        full |= over


def test_mix_meets_targets_and_limits(mixed_input):
    got = mixing.mix(mixed_input).collect()
    assert len(got) == mixed_input.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(d.words for d in r.draws)
        assert all(0 <= d.first and d.first + d.words <= r.size and 0 <= d.shard < mixing.SHARDS for d in r.draws)
    want = resharded(dict(sizes))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] for r in got if r.source == s)


def test_sources_of_fewer_words_than_blocks_meet_their_targets(spark):
    rows = [(1, "a", words(1)), (2, "b", words(3)), (3, "c", words(60)), (4, None, words(127))]
    rows += [(10 + i, "d", words(1)) for i in range(3)] + [(20 + i, "e", words(20)) for i in range(3)] + [(30 + i, "f", words(1)) for i in range(127)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    taken, targets = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert r.taken <= mixing.PASSES * r.size
    assert {s: abs(taken[s] - t) <= 0.5 for s, t in targets.items()} == dict.fromkeys(targets, True)
    assert sum(n == 2 * size for n, size in ((taken["a"], 1), (taken["b"], 3), (taken["c"], 60))) > 0
    assert mixing.mixed_documents(docs).agg(F.sum(n_words(F.col("text")))).first()[0] == sum(taken.values())


def test_mix_takes_no_word_twice_in_a_pass_and_reruns_agree(mixed_input):
    first, again = (sorted(mixing.mix(mixed_input).select("doc_id", "taken", F.to_json("draws")).collect(), key=str) for _ in range(2))
    assert first == again
    for r in mixing.mix(mixed_input).collect():
        for p in range(2):
            spans = sorted((d.first, d.words) for d in r.draws if d["pass"] == p)
            assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


def test_tree_deals_blocks_evenly(mixed_input):
    blocks = defaultdict(int)
    for r in mixing.mix(mixed_input).collect():
        for d in r.draws:
            blocks[d.shard] += d.words
    assert len(blocks) == mixing.SHARDS and max(blocks.values()) < 2 * min(blocks.values())


def test_hypergeometric_draw(spark):
    expr = mixing._hypergeometric("rest", "quota", "need", "u")
    df = spark.range(20_000).selectExpr("100L rest", "30L quota", "40L need", "(id + 0.5D) / 20000 u").selectExpr(f"{expr} k")
    mean, var, low, high = df.agg(F.avg("k"), F.var_pop("k"), F.min("k"), F.max("k")).first()
    assert abs(mean - 12) < 0.01 and abs(var - 40 * 0.3 * 0.7 * 60 / 99) < 0.05 and 0 <= low <= high <= 30
    assert spark.sql(f"select {mixing._hypergeometric('10L', '10L', '4L', '0.3D')}, {mixing._hypergeometric('10L', '0L', '4L', '0.3D')}").first() == (4, 0)


@pytest.mark.parametrize(("rest", "quota", "need"), [(2_000_000, 700_000, 900_000), (10**6, 3, 500_000)])
def test_hypergeometric_draw_of_many_blocks(spark, rest, quota, need):
    expr = mixing._hypergeometric("rest", "quota", "need", "u")
    df = spark.range(400).selectExpr(f"{rest}L rest", f"{quota}L quota", f"{need}L need", "(id + 0.5D) / 400 u").selectExpr(f"{expr} k")
    mean, var = df.agg(F.avg("k"), F.var_pop("k")).first()
    p = quota / rest
    assert abs(mean - need * p) < 1 and abs(var / (need * p * (1 - p) * (rest - need) / (rest - 1)) - 1) < 0.05


def test_what_is_taken_comes_through_the_tree(mixed_input, monkeypatch):
    whole = {(r.doc_id, r.size): r.taken for r in mixing.mix(mixed_input).collect()}
    tree = mixing.leaf_quotas
    monkeypatch.setattr(mixing, "leaf_quotas", lambda sources: tree(sources).where("shard < 8"))
    half = {(r.doc_id, r.size): r for r in mixing.mix(mixed_input).collect()}
    assert {d.shard for r in half.values() for d in r.draws} == set(range(8))
    assert 0.4 < sum(r.taken for r in half.values()) / sum(whole.values()) < 0.6
    monkeypatch.setattr(mixing, "leaf_quotas", lambda sources: tree(sources).withColumn("shard", F.lit(0).cast("long")))
    assert {d.shard for r in mixing.mix(mixed_input).collect() for d in r.draws} == {0}


def test_tree_of_many_sources_deals_exact_quotas(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 16)
    quotas = spark.range(3000).selectExpr("id", "1 + id % 7 as quota")
    leaves = mixing.leaf_quotas(quotas).collect()
    ranks, shards = defaultdict(list), defaultdict(int)
    for r in leaves:
        ranks[r.id].append((r.first, r.last))
        shards[r.shard] += r.last - r.first
    for i in range(3000):
        spans = sorted(ranks[i])
        assert spans[0][0] == 0 and spans[-1][1] == 1 + i % 7 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert max(shards.values()) - min(shards.values()) <= 1
    # each shard's share of the sources with the largest quota is that of all blocks, but for chance
    large = [sum(r.last - r.first for r in leaves if r.shard == s and r.id % 7 == 6) for s in range(mixing.SHARDS)]
    mean = sum(large) / 16
    assert abs(np.array(large) - mean).max() < 5 * (mean * 0.75) ** 0.5


def test_mixed_documents_keep_columns_and_words(mixed_input):
    out = mixing.mixed_documents(mixed_input)
    assert out.columns == mixed_input.columns
    assert out.agg(F.sum(n_words(F.col("text")))).first()[0] == mixing.mix(mixed_input).agg(F.sum("taken")).first()[0]


def test_mixed_documents_stand_by_shard_and_are_shuffled(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}", f"t{i} " + words(40)) for i in range(400)], "doc_id long, source string, text string")
    shard_of = {}
    for r in mixing.mix(docs).collect():
        for d in reversed(r.draws):
            shard_of[r.doc_id, d["pass"]] = d.shard
    out = mixing.mixed_documents(docs).select("doc_id", F.spark_partition_id().alias("part")).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in shard_of)
    once = {i: shard_of[i, 0] for i, p in shard_of if (i, 1) not in shard_of and p == 0}
    parts = defaultdict(list)
    for r in out:
        parts[r.part].append(r.doc_id)
    for ids in parts.values():
        shards = [once[i] for i in ids if i in once]
        assert shards == sorted(shards)
    assert any(ids != sorted(ids) for ids in parts.values()) and len(set(shard_of.values())) == mixing.SHARDS


def test_mix_sources_tell_their_shards(spark, sf_dir):
    rows = mixing.op2_mix_sources(spark, sf_dir).collect()
    assert all(bool(r.shards) == (r.taken > 0) for r in rows)
    assert {s for r in rows for s in r.shards} == set(range(mixing.SHARDS))


def test_mix_lays_out_and_takes_empty_tables(mixed_input, spark):
    laid = mixing.laid_out(mixing.mix(mixed_input))
    assert laid.agg(F.sum("words")).first()[0] == mixing.mix(mixed_input).agg(F.sum("taken")).first()[0]
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []


def test_shards_are_even_gapless_and_keep_equal_texts_together(spark):
    rows = [(i, words(i % 50) + f" {i // 2}", "c") for i in range(800)] + [(900 + i, "hot text", "c") for i in range(400)] + [(None, None, "c"), (5000, None, "c"), (5000, "", "c")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, slot string")).collect()
    assert len(got) == len(rows)
    by_text, slots, sizes = defaultdict(set), defaultdict(list), defaultdict(int)
    texts = {(i, t) for i, t, _ in rows}
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        by_text[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(16))
    want = {(i, None if t is None else zlib.crc32(t.encode()), len((t or "").encode()) + 1) for i, t in texts}
    assert {(r.doc_id, r.text_crc32, r["size"]) for r in got} == want


def test_capacity_is_the_smallest_feasible(spark):
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 300):
        sizes = [int(x) for x in rng.integers(1, 100, n)]
        cut = sharding._cuts(spark.createDataFrame(list(enumerate(sizes)), "g int, bytes long"), 4).first()

        def shards(cap, sizes=sizes):
            open_, room = 1, cap
            for s in sizes:
                open_, room = (open_, room - s) if s <= room else (open_ + 1, cap - s)
            return open_

        assert shards(cut.capacity) <= 4 and (cut.capacity == max(sizes) or shards(cut.capacity - 1) > 4)
        assert len(cut.ends) + 1 <= 4


@pytest.mark.parametrize("share", [0.1, 0.2, 1 / 3])
def test_shards_beside_a_hot_text_are_even(share):
    sizes = [int(x) for x in np.random.default_rng(6).integers(50, 150, 3000)]
    for at in (0, 700, 1500, 2999):
        own = list(sizes)
        own[at] = int(share / (1 - share) * (sum(sizes) - sizes[at]))
        starts = sharding._places(own, 16)
        found = [sum(own[a:b]) for a, b in zip(starts, [*starts[1:], len(own)], strict=True)]
        cold = sorted(found)[:-1]
        assert len(found) == 16 and max(found) == own[at]
        assert max(cold) < 1.3 * (sum(own) - own[at]) / 15 and min(cold) > 0.7 * (sum(own) - own[at]) / 15


def test_places_keep_the_capacity_and_leave_no_shard_empty():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 17, 60):
        for _ in range(40):
            sizes = [int(x) for x in np.ceil(rng.pareto(1, n) * 10 + 1)]
            starts = sharding._places(sizes, 6)
            found = [sum(sizes[a:b]) for a, b in zip(starts, [*starts[1:], n], strict=True)]
            assert len(found) == min(6, n) and min(found) > 0
            capacity = next(x for x in range(max(sizes), sum(sizes) + 1) if len(sharding._runs(sizes, x)) <= 6)
            assert max(found) <= capacity


def test_a_hot_text_of_a_third_leaves_no_shard_empty(spark):
    rows = [(i, words(30) + f" {i}") for i in range(1500)] + [(5000 + i, words(30) + " hot") for i in range(750)]
    sizes = defaultdict(int)
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        sizes[r.shard] += r["size"]
    assert set(sizes) == set(range(16)) and sorted(sizes.values())[-2] < 0.07 * sum(sizes.values())


def test_sharding_an_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_best_fit_fills_and_downsizes():
    rng = np.random.default_rng(2)
    for sizes in (np.array([1]), np.array([600, 600]), rng.integers(1, 2048, 500), np.full(100, 700), np.array([512, 1024, 513, 3])):
        bins, offsets, capacity = packing.best_fit(sizes)
        for b in np.unique(bins):
            at = np.flatnonzero(bins == b)
            order = at[np.argsort(offsets[at])]
            assert (offsets[order] == np.cumsum(sizes[order]) - sizes[order]).all()
            used = sizes[at].sum()
            assert set(capacity[at]) == {min(c for c in packing.CAPACITIES if c >= used)}
    bins, _, capacity = packing.best_fit(np.full(4, 700))
    assert len(np.unique(bins)) == 2 and set(capacity) == {2048}


def plain_best_fit(sizes, capacities=packing.CAPACITIES):
    """Best fit piece by piece over a list of bins, without any index."""
    order, bins, open_ = sorted(range(len(sizes)), key=lambda i: -sizes[i]), {}, []
    for at, i in enumerate(order):
        fit = [b for b in open_ if b["room"] >= sizes[i]]
        if fit:
            least = min(b["room"] for b in fit)
            b = max((b for b in fit if b["room"] == least), key=lambda b: b["last"])
        else:
            rest = [sizes[j] for j in order[at + 1 :]]
            beside = lambda c: min(c - sizes[i], sum(x for x in rest if x <= c - sizes[i]))
            c = min((c for c in capacities if c >= sizes[i]), key=lambda c: ((c + packing.OVERHEAD) / (sizes[i] + beside(c)), c))
            b = {"room": c, "items": []}
            open_.append(b)
        b["room"] -= sizes[i]
        b["last"] = at
        b["items"].append(i)
    return sorted(tuple(sorted(b["items"])) for b in open_), {i: min(c for c in capacities if c >= sum(sizes[j] for j in b["items"])) for b in open_ for i in b["items"]}


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_the_plain_one(seed):
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in (rng.integers(1, 2048, 150) if seed % 2 else np.minimum(2047, rng.lognormal(5, 1.2, 250).astype(int) + 1))]
    bins, _, capacity = packing.best_fit(np.array(sizes))
    groups = defaultdict(list)
    for i, b in enumerate(bins):
        groups[b].append(i)
    want, downsized = plain_best_fit(sizes)
    assert sorted(tuple(sorted(x)) for x in groups.values()) == want
    assert dict(enumerate(capacity)) == downsized


def test_packing_keeps_whole_texts_and_counts_tokens(spark):
    library = Tokenizer.from_file(packing.VOCABULARY)
    odd = ["a b", "x" * 30_000 + " y", "日本語😀" * 2000, " " * 9000 + "z", "<|endoftext|>" * 3000 + "tail", "line one\n\n\tline two " * 900, " ".join(str(i) for i in range(4000))]
    rows = [(i, words(i * 37 % 900)) for i in range(150)] + [(7000, words(5000)), (7000, words(5000)), (None, "a b"), (1001, None), (1002, "")] + [(2000 + i, t) for i, t in enumerate(odd)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, tokens string, bin_id int")
    got = packing.pack(docs).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        assert (r.bin_id is None) == (r.tokens == 0) and r.tokens <= 2048
        if r.tokens:
            bins[r.bin_id].append(r)
    for doc_id, text in rows:
        own = sorted(pieces[doc_id], key=lambda r: r.piece)
        if doc_id == 7000:
            assert [r.piece for r in own] == sorted([*range(len(own) // 2)] * 2)
            own = own[::2]
        assert "".join(r.text for r in own) == (text or "")
        if (text or "").count("x") < 20_000 and not (text or "").startswith(" "):
            assert own[0].n_tokens == len(library.encode(text or "", add_special_tokens=False).ids)
        assert own[0].n_tokens == sum(r.tokens for r in own)
    for rs in bins.values():
        rs.sort(key=lambda r: r.bin_offset)
        assert len({r.capacity for r in rs}) == 1 and rs[-1].bin_offset + rs[-1].tokens <= rs[0].capacity
        assert all(a.bin_offset + a.tokens == b.bin_offset for a, b in zip(rs, rs[1:], strict=False))
    assert packing.pack(docs.limit(0)).collect() == []


def test_packing_in_rounds_wastes_little(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    filled = lambda rows: sum(r.tokens for r in rows) / sum({r.bin_id: r.capacity for r in rows if r.tokens}.values())
    assert filled(packing.pack(docs.coalesce(1)).collect()) > 0.99 and filled(packing.pack(docs.repartition(4)).collect()) > 0.95
    own = pd.DataFrame({"doc_id": range(40), "no_id": False, "text": [words(40 + i) for i in range(40)]})
    monkeypatch.setattr(packing, "WINDOW", 10)
    rows = pd.concat(packing._packer(packing.CAPACITIES, packing.VOCABULARY)(iter([own.iloc[:20], own.iloc[20:]])))
    assert sorted(rows["doc_id"]) == list(range(40)) and rows.groupby("bin_id")["tokens"].sum().max() <= 2048


def test_packing_query_is_whole(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    texts = defaultdict(dict)
    for r in packing.op9_pack_documents(spark, sf_dir).collect():
        texts[r.doc_id][r.piece] = r.text
    assert {i: "".join(t for _, t in sorted(ps.items())) for i, ps in texts.items()} == docs
