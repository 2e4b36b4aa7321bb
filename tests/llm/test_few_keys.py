"""Very many rows of few keys, columns with clashing names, and models that have learned nothing."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from motorfisc.llm import ann, exact, extraction, language, mixing, simhash, toxicity
from motorfisc.llm.common import bounded_sample

MANY = 120_000


@pytest.mark.parametrize("keys", [1, 2, 3, 5, 900, 5000, MANY])
def test_samples_hold_as_many_rows_as_there_are_keys(spark, keys):
    rows = spark.range(MANY).select((F.col("id") % keys).alias("k"), F.col("id").alias("x"))
    got = bounded_sample(rows, 1000, "s", "k").collect()
    assert len(got) == min(1000, keys) == len({r.k for r in got}) and all(r.x == r.k for r in got)
    assert got == bounded_sample(rows.repartition(7), 1000, "s", "k").collect()


def test_samples_of_null_keys_and_empty_tables(spark):
    rows = spark.range(MANY).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("x"))
    assert [r.x for r in bounded_sample(rows, 10, "s", "k").collect()] == [0]
    assert bounded_sample(rows.limit(0), 10, "s", "k").collect() == []


@pytest.fixture(scope="module")
def vectors(spark):
    """Three ids, one of them a query, with vectors that all differ."""
    x = [((F.xxhash64("id", F.lit(i)) % 1000) / 100).cast("float") for i in range(4)]
    return spark.range(MANY).select((F.col("id") % 3 * 50).alias("vec_id"), F.array(*x).alias("embedding")).cache()


def test_exact_search_over_few_ids_is_brute_force(spark, vectors):
    rows = vectors.toPandas()
    v, ids = np.floor(1024 * np.stack(rows["embedding"].to_list()).astype(float)), rows["vec_id"].to_numpy()
    got = exact.search(vectors).orderBy("query_id", "rank").collect()
    own = {q: tuple(min(map(tuple, v[ids == q]))) for q in (0, 100)}
    for q in (0, 100):
        scores = v @ np.array(own[q])
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:10]
        assert [(r.vec_id, r.score) for r in got if r.query_id == q] == [(ids[i], int(scores[i])) for i in order]
    assert len(got) == 20


def test_near_search_over_few_ids(spark, vectors):
    got = ann.search(vectors).collect()
    assert len(got) == 20 and {(r.query_id, r.vec_id) for r in got} <= {(0, 50), (0, 100), (100, 0), (100, 50)}


def test_languages_of_documents_without_ids(spark):
    words = {"aa": "the thing with them", "bb": "der die das und nicht", "cc": "que les des une dans"}
    docs = spark.range(MANY).select(F.lit(None).cast("long").alias("doc_id"), F.element_at(F.create_map(*[F.lit(x) for k, v in words.items() for x in (k, v)]), F.element_at(F.array(*[F.lit(k) for k in words]), (F.col("id") % 3 + 1).cast("int"))).alias("words"), F.element_at(F.array(*[F.lit(k) for k in words]), (F.col("id") % 3 + 1).cast("int")).alias("lang"), "id")
    docs = docs.select("doc_id", F.concat_ws(" ", "words", (F.col("id") % 50).cast("string")).alias("text"), "lang")
    model = language.train(docs)
    assert model.languages == ["aa", "bb", "cc"] and language.identify(docs.limit(300), model).where("lang <> lang_pred").count() == 0
    assert language.keep_identified(docs, model).count() == MANY


def test_equal_pages_are_one_page_to_learn_from(spark):
    one = "<html><body><nav><a>menu</a></nav><article><p>" + "words of a text " * 30 + "</p></article></body></html>"
    pages = spark.range(MANY).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit(one).alias("html"))
    assert [r.html for r in bounded_sample(pages.select("html"), extraction.TRAIN_ROWS, "pages", "html").collect()] == [one]


@pytest.fixture
def clashing(spark):
    """Documents whose columns have the names that stages use, with values of other types."""
    names = ["score", "predicted", "_p", "lang_pred", "size", "_size", "_row", "_kept", "fp", "n", "taken", "target", "draws", "_h", "_shard", "_chunk", "_salt"]
    rows = [(i, "the thing with them and more of it " * 3 + f"number {i} " * 20, "en", f"s{i % 3}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return docs.select("*", *[F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in names])


def test_stages_keep_the_values_of_clashing_columns(spark, clashing):
    one = np.array([1 << toxicity.HASH_BITS]), np.array([-3.0])
    outs = {
        "language": language.keep_identified(clashing, language.train(clashing)),
        "toxicity": toxicity.keep_clean(clashing, one),
        "simhash": simhash.keep_one(clashing),
        "mixing": mixing.mixed_documents(clashing),
    }
    before = {r.doc_id: r.asDict() for r in clashing.collect()}
    for name, out in outs.items():
        assert out.schema == clashing.schema or [f.dataType for f in out.schema] == [f.dataType for f in clashing.schema], name
        rows = out.collect()
        assert rows, name
        for r in rows:
            want = before[r.doc_id] | ({"text": r.text} if name == "mixing" else {})
            assert r.asDict() == want, name


def test_stages_that_have_learned_nothing_keep_all(spark, clashing):
    unlearned = language.train(clashing.where("false"))
    assert unlearned.languages == [] and language.keep_identified(clashing, unlearned).collect() == clashing.collect()
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        model = toxicity.train(clashing, known)
        assert len(model[0]) == 0 and toxicity.keep_clean(clashing, model).count() == 30


@pytest.fixture
def tables(spark, sf_dir, tmp_path):
    def made(**empty):
        for name in ("documents", "labels"):
            df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            (df.limit(0) if empty.get(name) else df).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return made


def test_pipeline_of_no_labels_keeps_documents(spark, tables):
    assert corpus_pipeline.run(spark, tables(labels=True)).where("tokens > 0").select("doc_id").distinct().count() > 100


def test_pipeline_of_no_documents(spark, tables):
    assert corpus_pipeline.run(spark, tables(documents=True)).collect() == []
