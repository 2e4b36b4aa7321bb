import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motorfisc.llm import language, tokens, toxicity
from motorfisc.llm.common import crc_mod

ODD = [None, "", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "aaaaaaaaaaa", "!!" * 40, "日本語 😀😀 ü", "x" * 3000, "ab" * 700 + " c", "\n\n \t  x", "it's we'll I'd", "1234567 89", "\x00�"]


def test_token_counts_are_the_librarys(spark, sf_dir):
    library = Tokenizer.from_file(tokens.VOCABULARY)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    rows = {r.doc_id: r for r in tokens.token_counts(docs).collect()}
    for doc_id, text in docs.collect():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        r = rows[doc_id]
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((text or "").encode()), n > 512), text


def test_token_counts_around_white_space_are_the_librarys():
    library, model = Tokenizer.from_file(tokens.VOCABULARY), tokens.merges(tokens.VOCABULARY)
    rng = np.random.default_rng(11)
    letters = list(" \n\t\u00a0ab,1'é\u2003\x1c") + ["  ", " a", "word ", "'s", "<|endoftext|>", "a" * 60]
    texts = ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(4000)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [(t, n) for t, n in zip(texts, model.counts(texts), strict=True)] == list(zip(texts, want, strict=True))
    for text, pieces in zip(texts, model.cut(texts, 4), strict=True):
        assert "".join(p for p, _ in pieces) == text and all(0 < n <= 4 for _, n in pieces)


def test_token_counts_of_an_empty_table_and_clashing_columns(spark):
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x")], "doc_id long, text string, n_tokens string")
    assert [r.n_tokens for r in tokens.token_counts(df).collect()] == [2, 2]


def segmentations(word, p, single):
    """Sum over all ways to cut a word into pieces, by their last piece, in exact fractions of whole numbers."""
    sums = [Fraction(1)]
    for end in range(1, len(word) + 1):
        sums.append(sum((sums[start] * Fraction(p.get(word[start:end], single if end - start == 1 else 0.0)) for start in range(end)), Fraction(0)))
    return sums[-1]


def test_pieces_are_all_letter_pieces_of_the_vocabulary():
    model = sentencepiece.SentencePieceProcessor(model_file=language.VOCABULARY)
    known = {int(h) for h in language._pieces(language.VOCABULARY)[0]}
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    letters = {p.lower() for p in pieces if p.lstrip("▁").isalpha() and p.count("▁") == (p[0] == "▁")}
    assert {language._hash_of(p) for p in letters} == known and max(map(len, letters)) > 12


def test_forward_sums_all_segmentations():
    counts = pd.DataFrame([("a", "the", 5), ("a", "thing", 2), ("a", "international", 3), ("b", "der", 4), ("b", "ding", 3), ("b", "gesellschaft", 3)], columns=["lang", "word", "n"])
    model = language.fit(counts)
    hashes, order = language._pieces(model.path)
    known = {int(h): int(i) for h, i in zip(hashes, order, strict=True)}
    words = ["the", "thunder", "ß", "internationalisation", "Gesellschaft".lower(), "q" * 40, "donaudampfschifffahrtsgesellschaftskapitän", "ab" * 300]
    got = model.word_scores(words)
    for row, word in enumerate(words):
        part = "▁" + word
        spans = {part[i:j] for i in range(len(part)) for j in range(i + 1, min(len(part), i + 20) + 1)}
        for column in range(2):
            p = {x: model.probabilities[known[h], column] for x in spans if (h := language._hash_of(x)) in known}
            want = segmentations(part, p, model.probabilities[-1, column])
            assert got[row, column] == pytest.approx(math.log(want.numerator) - math.log(want.denominator))
    assert (got[4, 1] > got[4, 0]) and (got[3, 0] > got[3, 1])


def test_language_of_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language.op7_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the of and with this", "en"), ("der die und nicht von", "de")] * 5)], "doc_id long, text string, lang string")
    model = language.train(train)
    docs = spark.createDataFrame([(1, None, "k"), (2, "123 !?", "k"), (3, "und die " * 40_000, "k"), (3, "THE of", "k"), (4, "日本", "k")], "doc_id long, text string, score string")
    got = {(r.doc_id, r.lang_pred) for r in language.identify(docs, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "de"), (3, "en")} <= got
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {3} and not {1, 2} & {r.doc_id for r in kept.collect()}
    nothing = language.train(train.where("doc_id < 0"))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).collect() == []


def test_toxicity_of_held_out_rows(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = []
    for i in range(1500):
        toxic = i % 5 == 0
        ws = list(rng.choice(vocabulary, 60)) + (list(rng.choice(["grawlix", "blasted"], 3)) if toxic else [])
        rows.append((i, " ".join(rng.permutation(ws)), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, toxicity.training_rows(labels))
    assert 0 < len(model[0]) < 3000
    got = toxicity.score(docs, model).join(labels, "doc_id").where(held & F.col("toxic").isNotNull()).collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.97
    odd = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (2, "", "c"), (3, "grawlix blasted " * 50_000, "c")], "doc_id long, text string, predicted string")
    scores = toxicity.score(odd, model).orderBy("doc_id").collect()
    assert [r.predicted for r in scores] == [0, 0, 0, 1] and scores[0].score == scores[1].score
    assert toxicity.keep_clean(odd, model).columns == odd.columns and toxicity.score(odd.limit(0), model).collect() == []
    assert toxicity.train(docs.limit(0), labels)[0].size == 0


def test_skip_grams_and_row_edges():
    row, feature = toxicity._features(["a b c", None, "a", "c d"], toxicity._Hashes())
    assert np.bincount(row, minlength=4).tolist() == [6, 0, 1, 3]
    again = toxicity._features(["x a b c"], toxicity._Hashes())[1]
    assert set(feature[row == 0]) <= set(again)
