import corpus_pipeline
from pyspark.sql import functions as F

from motorfisc.llm.common import n_words


def test_stages_narrow_and_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**7, None, None, None, None), (10**7 + 1, "123 456", "en", "src0", 7)], docs.schema)
    first, seen = docs.unionByName(extra), {}
    step = first
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, sf_dir).cache()
        seen[name] = step
        if name != "packing":
            assert step.columns == docs.columns
    assert {r.doc_id for r in first.select("doc_id").subtract(seen["language_id"].select("doc_id")).collect()} == {10**7, 10**7 + 1}
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1")
    gone = seen["language_id"].join(seen["toxicity"], "doc_id", "left_anti")
    assert gone.join(toxic, "doc_id").count() >= 0.5 * gone.count() > 0
    assert seen["near_dedup"].count() == seen["near_dedup"].select("text").distinct().count()
    count = lambda df: df.agg(F.sum(n_words(F.col("text")))).first()[0]
    assert abs(count(seen["mixing"]) - 1.5 * count(seen["near_dedup"])) < 50
    # pieces put together give back each mixed text
    pieces = seen["packing"].groupBy("bin_id").agg(F.sum("tokens").alias("n"), F.max("capacity").alias("c"))
    assert pieces.where("bin_id is not null and n > c").count() == 0
    chars = lambda df: df.agg(F.sum(F.length("text"))).first()[0]
    assert chars(seen["packing"]) == chars(seen["mixing"])
    whole = seen["packing"].groupBy("doc_id").agg(F.count(F.when(F.col("piece") == 0, 1)).alias("n"), F.max("piece").alias("last"))
    once = whole.where("n = 1").join(seen["packing"], "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("p"))
    joined = once.select("doc_id", F.array_join("p.text", "").alias("joined")).join(seen["mixing"].select("doc_id", "text"), "doc_id")
    assert joined.where("joined <> text").count() == 0 and joined.count() > 10


def test_run_is_the_stages_one_after_another(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 0
