"""What searches show and count, told from different months, periods and texts, against the plain forms over all pairs."""

from motorfisc.functions import text as txt
from motorfisc.operators import corpus
from motorfisc.plans import corpus_queries as cq
from motorfisc.plans.derived import derive
from pyspark.sql import functions as F

c = F.col


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def inputs(spark, sf_dir):
    v = derive(spark, sf_dir, "vehicles").withColumnRenamed("vehicle_id", "query_id")
    v = v.unionByName(v.withColumn("query_id", c("query_id") + 1000))
    return v, derive(spark, sf_dir, "engines").where("engine_id % 2 = 0")


def test_scope_and_articles(spark, sf_dir):
    v, e = inputs(spark, sf_dir)
    pairs = v.join(e, "brand")
    assert rows(corpus.shown_rows(v, e), "query_id", "engine_id") == rows(corpus.in_scope(pairs, "query_id"), "query_id", "engine_id")
    article = F.when(c("query_id") % 3 == 0, "BMW E90").when(c("query_id") % 3 == 1, F.concat("brand", F.lit(" Golf VII")))
    v = v.withColumn("article", article)
    pairs = v.join(e, "brand")
    want = corpus.of_article(corpus.in_scope(pairs, "query_id"), pairs, "query_id")
    assert rows(corpus.shown_rows(v, e), "query_id", "engine_id") == rows(want, "query_id", "engine_id")


def test_reasons_and_credits(spark, sf_dir):
    v, e = inputs(spark, sf_dir)
    v = v.withColumnRenamed("query_id", "vehicle_id")
    pairs = v.join(e, "brand")
    want = pairs.groupBy("vehicle_id", corpus.drop_reason(pairs).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    assert rows(corpus.drop_counts(v, e), "vehicle_id", "reason", "n") == rows(want, "vehicle_id", "reason", "n")
    q = v.select(c("vehicle_id").alias("query_id"), "brand", txt.corpus_text(c("v_model")).alias("q_text"))
    pairs = q.join(e.withColumn("hay", txt.corpus_text(F.concat_ws(" ", "title", "engine_code"))), "brand")
    want = corpus._credits(pairs, "query_id", "engine_id", False).where("credit > 0").groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("rows_met"), F.round(F.sum("credit"), 6).alias("credits"))
    got = corpus.word_credits(q, e).withColumn("credits", F.round("credits", 6))
    assert rows(got, "query_id", "token", "rows_met", "credits") == rows(want, "query_id", "token", "rows_met", "credits")


def test_first_rows_of_a_search_are_those_of_all_its_rows(spark, sf_dir):
    q, e = cq._searches(spark, sf_dir), corpus.eligible(derive(spark, sf_dir, "engines"))
    names = ["query_id", "place", "engine_id", "value", "honoured"]
    whole = rows(corpus.browse_engines(q, e, 1_000_000), *names)
    assert rows(corpus.browse_engines(q, e, 3), *names) == [r for r in whole if r[1] <= 3]
    pool = corpus.in_scope(q.join(e.withColumn("hay", txt.corpus_text(F.concat_ws(" ", "title", "engine_code"))), "brand"), "query_id")
    met = corpus.ranked_by_coverage(pool.where("q_text <> ''"), "query_id", "engine_id").select("query_id", "engine_id")
    want = met.unionByName(pool.where("q_text = ''").select("query_id", "engine_id"))
    assert sorted((r[0], r[2]) for r in whole) == sorted(map(tuple, want.collect()))
