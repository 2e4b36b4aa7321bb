"""The learned models and the mix beside plain forms of their own, written from their definitions."""

import math
from collections import defaultdict

import numpy as np

from motorfisc.llm import extraction, mixing, toxicity


def plain_ftrl(rows, labels):
    """Per-coordinate FTRL-proximal over sets of features, one coordinate at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for features, y in zip(rows, labels, strict=True):
            own = [*features, 1 << toxicity.HASH_BITS]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for i in own:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: w for i in z if (w := weight(i))}


def test_weights_are_those_of_plain_ftrl():
    rng = np.random.default_rng(7)
    rows = [np.unique(rng.integers(0, 400, 30)) for _ in range(600)]
    labels = [int(7 in r or rng.random() < 0.05) for r in rows]
    places, weights = toxicity.fit(rows, labels)
    want = plain_ftrl([r.tolist() for r in rows], labels)
    assert set(places.tolist()) == set(want) and 0 < len(want) < 401
    assert all(abs(w - want[i]) < 1e-9 for i, w in zip(places.tolist(), weights.tolist(), strict=True))


def plain_logits(page, w):
    """The bidirectional LSTM, block by block and gate by gate."""
    size, sigmoid = extraction.STATE, lambda x: 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    def run(blocks, way):
        h, c, out = [0.0] * size, [0.0] * size, []
        for x in blocks:
            a = [float(x @ w[way + "x"][:, j] + np.dot(h, w[way + "h"][:, j]) + w[way + "0"][j]) for j in range(4 * size)]
            i, f, o = ([sigmoid(v) for v in a[k * size : (k + 1) * size]] for k in range(3))
            g = [math.tanh(v) for v in a[3 * size :]]
            c = [f[k] * c[k] + i[k] * g[k] for k in range(size)]
            h = [o[k] * math.tanh(c[k]) for k in range(size)]
            out.append(h)
        return out

    ahead, back = run(page, "f"), run(page[::-1], "b")[::-1]
    return [float(np.dot([*a, *b], w["o"]) + w["o0"][0]) for a, b in zip(ahead, back, strict=True)]


def test_logits_are_those_of_a_plain_lstm():
    rng = np.random.default_rng(3)
    net = extraction.Labeller()
    net.w["o"] = rng.standard_normal(net.w["o"].shape)
    pages = [rng.standard_normal((n, extraction.PATH + extraction.WORDS + extraction.OTHER)) * (rng.random((n, 1)) < 0.8) for n in (5, 0, 1, 9, 5)]
    for page, got in zip(pages, net.logits(pages), strict=True):
        assert len(got) == len(page) and np.allclose(got, plain_logits(page, net.w), atol=2e-4)



def test_the_mix_is_what_a_plain_replay_of_its_leaves_takes(spark):
    """Words by source and shard, from the leaves' block ranges walked one by one, beside what the documents say."""
    rng = np.random.default_rng(5)
    rows = [(i if i % 7 else None, f"s{i % 3}", " ".join(f"w{j}" for j in range(int(rng.integers(1, 90))))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").cache()
    mixed = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.text, r.draws)
    assert sorted(map(key, mixed), key=repr) == sorted(map(key, again), key=repr)  # reruns cut the same texts at the same words
    sizes = {r.source: (r.source_size, r.target) for r in mixed}
    blocks = {s: max(mixing.LEAST_BLOCKS, -(-n // mixing.BLOCK_WORDS)) for s, (n, _) in sizes.items()}
    taken = defaultdict(int)
    for r in mixed:
        for d in r.draws:
            taken[r.source, d["pass"], d.shard] += d.words
    for s, (size, target) in sizes.items():
        edges = [b * size // blocks[s] for b in range(blocks[s] + 1)]
        units = [(p, b) for p in range(mixing.PASSES) for b in range(blocks[s]) if edges[b + 1] > edges[b]]
        assert sum(edges[b + 1] - edges[b] for _, b in units) == mixing.PASSES * size
        total = sum(n for (of, _, _), n in taken.items() if of == s)
        assert total == round(target)
        # whole blocks but for the last one: what a shard takes of a pass is a sum of block widths, or that less the cut
        widths = {edges[b + 1] - edges[b] for _, b in units}
        assert max(widths) - min(widths) <= 1
    by_shard = defaultdict(int)
    for (_, _, shard), n in taken.items():
        by_shard[shard] += n
    assert len(by_shard) == mixing.SHARDS and max(by_shard.values()) < 1.2 * min(by_shard.values())


def test_rows_without_ids_are_spread_over_slices_and_chunks_grow(spark):
    docs = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'one' as source", "concat('text ', id, ' of some words') as text")
    h = mixing.sized(docs).selectExpr(f"shiftright(xxhash64({mixing.SEED}, doc_id, _salt), {64 - mixing.SLICE_BITS}) as s").distinct().count()
    assert h > 500
    assert mixing.chunks_of(0, 8) == mixing.CHUNKS and mixing.chunks_of(1e12, 8) == math.ceil(1e12 / mixing.SHARDS / mixing.CHUNK_WORDS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = mixing.mixed_documents(docs).selectExpr("spark_partition_id() as p").distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts > 256


def test_blocks_of_very_large_sources_dont_overflow(spark):
    size, blocks = 9 * 10**15, 1 << 20
    row = spark.sql(f"select {size}L as source_size, {blocks}L as blocks, {blocks - 1}L as b").selectExpr("b * (source_size div blocks) + cast(floor(b * (source_size % blocks) / blocks) as long) as e").first()
    assert row.e == (blocks - 1) * size // blocks
