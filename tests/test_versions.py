import tempfile

import pytest
from motorfisc.sources import versions


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="versions-") + "/t"


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x long")


def put(spark, path, writer, batch, *values):
    def make(old):
        before = old("rows")
        new = rows(spark, *values)
        return {"rows": new if before is None else before.unionByName(new)}

    return versions.commit(spark, path, make, writer, batch)


def held(spark, path, **which):
    return sorted(r.x for r in versions.read(spark, path, **which).collect())


def test_batches_go_in_once_whoever_writes_them(spark, path):
    assert versions.read(spark, path) is None and versions.latest(spark, path) is None
    assert put(spark, path, "a", 0, 1) and put(spark, path, "a", 1, 2)
    assert not put(spark, path, "a", 1, 99) and not put(spark, path, "a", 0, 99)
    assert put(spark, path, "b", 0, 3)
    assert held(spark, path) == [1, 2, 3] and held(spark, path, number=0) == [1]
    assert versions.latest(spark, path).batches == {"a": 1, "b": 0}


def test_a_write_that_dies_leaves_the_table(spark, path, monkeypatch):
    put(spark, path, "a", 0, 1)

    def broken(old):
        return {"rows": rows(spark, 5), "other": rows(spark, 1).selectExpr("1 / (x - x) as y")}

    with pytest.raises(Exception, match="(?i)divi"):
        versions.commit(spark, path, broken, "a", 1)
    assert held(spark, path) == [1]
    monkeypatch.setattr(versions, "_publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        put(spark, path, "a", 1, 2)
    monkeypatch.undo()
    assert held(spark, path) == [1]
    assert put(spark, path, "a", 1, 2) and held(spark, path) == [1, 2]


def test_of_two_writers_one_wins(spark, path):
    put(spark, path, "a", 0, 1)

    def slow(old):
        put(spark, path, "b", 0, 2)
        return {"rows": old("rows").unionByName(rows(spark, 3))}

    with pytest.raises(versions.Outrun):
        versions.commit(spark, path, slow, "a", 1)
    assert held(spark, path) == [1, 2]
    assert put(spark, path, "a", 1, 3) and held(spark, path) == [1, 2, 3]


def test_parts_are_committed_together_and_old_versions_go(spark, path):
    for n in range(4):
        versions.commit(spark, path, lambda old, n=n: {"rows": rows(spark, n)} | ({"review": rows(spark, 9)} if n == 1 else {}), "a", n)
    assert held(spark, path) == [3] and held(spark, path, part="review") == [9]
    assert versions.vacuum(spark, path, keep=1) == 2
    assert held(spark, path) == [3] and held(spark, path, part="review") == [9] and put(spark, path, "a", 4, 7)
