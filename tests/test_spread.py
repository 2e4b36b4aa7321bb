"""Articles are laid out in many tasks, however few files their table has."""

from motorfisc.plans import page_queries  # noqa: F401
from motorfisc.plans.derived import derive


def test_articles_of_one_file_are_many_tasks_work(spark, sf_dir):
    plain, spread = (derive(spark, sf_dir, "wiki_articles", spread=s) for s in (False, True))
    assert spread.rdd.getNumPartitions() >= 4 and spread.select("title").where("title is not null").count() == plain.count()
    assert spread.exceptAll(plain).isEmpty()
