import random
import re
import zlib
from collections import Counter

import pytest
from motorfisc.llm import spelling
from motorfisc.llm.spelling import Acceptor


def near(x, y):
    x, y = sorted((x, y), key=len)
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain_vocabulary(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    """Near words by what is left when a letter is taken out, looked up one by one."""
    gaps = {}
    for w in words:
        for i in range(len(w)):
            gaps.setdefault(w[:i] + "\0" + w[i + 1 :], set()).add(w)
            gaps.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    out, forms = {}, {}
    for w in words:
        found = set().union(*[gaps[w[:i] + "\0" + w[i + 1 :]] for i in range(len(w))], *[{w[:i] + w[i + 1 :]} & words.keys() for i in range(len(w))], gaps.get(w, set())) - {w}
        found = {x for x in found if near(w, x)}
        best = min(found, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 10 * words[w] else None
        out[w] = len(found)
    rows = set()
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.add((w, forms[w], root, n, out[w], words.get(forms[w])))
    return rows


@pytest.mark.parametrize("letters", ["a", "ab", "abc"])
def test_composition_finds_each_pair_one_edit_apart_once(letters):
    rng = random.Random(1)
    for _ in range(400):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 16))})
        want = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])]
        assert sorted(tuple(sorted(p)) for p in Acceptor(words).near()) == want


def test_acceptor_is_minimal_and_holds_very_long_words():
    # the initial state, that after a b, and the eight along the path that all words end with
    made = Acceptor(sorted(a + "inging" + s for a in ("s", "r", "br") for s in ("", "s")))
    assert len(made.arcs) == 2 + len("inging") + 2
    long = "ab" * 20_000
    assert sorted(Acceptor(sorted([long, long + "c", "x" + long[1:]])).near()) == [(0, 1), (0, 2)]


@pytest.mark.parametrize("most", [2, 7, 1 << 14])
def test_variants_equal_brute_force_however_partitions_are_cut(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 9))): rng.choice([2, 3, 20, 30, 400, 5000]) for _ in range(500)}
    words |= {"a" * 7 + c * k: 9 for c in "abz" for k in range(12)}
    got = spelling.variants(spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n int, form string"), most)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(words) and set(rows) == plain_variants(words)


def test_long_chains_of_forms_end_at_one_root(spark):
    chain = [("abcdefg" + "hijklmn"[:i], 2 * 10**i) for i in range(8)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert got == {w: chain[-1][0] for w, _ in chain}


def test_vocabulary_of_nulls_repeated_rows_and_long_texts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcÀÿ×Q") for _ in range(rng.randint(5, 9)))
    known = [word() for _ in range(60)]
    rows = [(i % 40 if i % 9 else None, rng.choice([None, "", " ".join(rng.choice(known) for _ in range(40))])) for i in range(200)]
    rows += [rows[-1]] * 3 + [(7, "Straßenbahn " * 3000), (8, "q" * 30_000), (9, "q" * 30_000 + "Ārest"), (1, "İstanbulu ISTANBULU istanbulu")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as word", "2 as n")
    got = spelling.vocabulary(docs).collect()
    assert len(got) == len({r.word for r in got}) and {r.word: r.n for r in got} == plain_vocabulary(rows)
    assert set(map(tuple, spelling.variants(spelling.vocabulary(docs)).collect())) == plain_variants(plain_vocabulary(rows))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(none)).collect() == []
    assert spelling.variants(spark.createDataFrame([(None, 3), ("abcdefgh", None)], "word string, n long")).collect() == []


def test_query_equals_brute_force_on_a_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = spelling.op12_spelling_variants(spark, sf_dir).collect()
    want = plain_variants(plain_vocabulary(rows))
    assert len(got) == len(want) and set(map(tuple, got)) == want and any(r.form for r in got)
