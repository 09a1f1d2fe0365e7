import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from kinroster.plans.tables import Table
from kinroster.plans.versions import Folder

LOG = "id string, n long, day date"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def log(spark, *given):
    return spark.createDataFrame([(i, n, dt.date(2024, m, 1)) for i, n, m in given], LOG)


def test_versions_are_taken_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "v"))
    assert folder.latest() == (0, None)
    assert folder.commit(1, {"a": 1}) and not folder.commit(1, {"a": 2}) and folder.commit(2, {"a": 3})
    assert folder.latest() == (2, {"a": 3}) and folder.read(1) == {"a": 1} and folder.numbers() == [1, 2]
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if folder.commit(3, {"by": i}) else None) for i in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(won) == 1 and folder.read(3) == {"by": won[0]}


@pytest.mark.parametrize("partition", [None, "day"])
def test_merge_by_key(spark, tmp_path, partition):
    t = Table(spark, str(tmp_path / "t"), ("id",), partition)
    assert not t.exists
    t.merge(log(spark, ("a", 1, 1), ("b", 2, 1), (None, 0, 2)))
    t.merge(log(spark, ("a", 1, 1), ("a", 1, 1), ("c", 3, 2)))  # an event that comes twice is one row
    assert rows(t.read().select("id", "n")) == [("a", 1), ("b", 2), ("c", 3), (None, 0)]
    t.merge(log(spark, ("b", 20, 2), (None, 7, 2), ("d", 4, 3)))
    assert rows(t.read().select("id", "n")) == [("a", 1), ("b", 20), ("c", 3), ("d", 4), (None, 7)]
    assert rows(t.read(2).select("id", "n")) == [("a", 1), ("b", 2), ("c", 3), (None, 0)]
    with pytest.raises(ValueError, match="different rows"):
        t.merge(log(spark, ("e", 1, 1), ("e", 2, 1)))
    t.merge(log(spark))  # nothing
    assert t.read().count() == 5


def test_an_append_rewrites_nothing(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), ("id",))
    t.merge(log(spark, ("a", 1, 1)))
    first = t.versions.latest()[1]["units"]
    t.merge(log(spark, ("b", 1, 1)))
    assert first[0] in t.versions.latest()[1]["units"]
    t.merge(log(spark, ("a", 2, 1)))
    assert first[0] not in t.versions.latest()[1]["units"]


def test_schema_changes(spark, tmp_path):
    more = spark.createDataFrame([("b", 2, dt.date(2024, 1, 1), "x")], LOG + ", who string")
    for mode, columns in (("ignore", ["id", "n", "day"]), ("append_new_columns", ["id", "n", "day", "who"]), ("sync_all_columns", ["id", "n", "day", "who"])):
        t = Table(spark, str(tmp_path / mode), ("id",))
        t.merge(log(spark, ("a", 1, 1)))
        t.merge(more, mode)
        assert t.read().columns == columns and t.read().count() == 2
    assert rows(t.read().select("id", "who")) == [("a", None), ("b", "x")]
    t.merge(log(spark, ("c", 3, 1)).drop("day"), "append_new_columns")
    assert t.read().columns == columns and t.read().filter("id = 'c' AND day IS NULL").count() == 1
    t.merge(log(spark, ("a", 5, 1)).drop("day"), "sync_all_columns")
    assert rows(t.read()) == [("a", 5), ("b", 2), ("c", 3)]
    with pytest.raises(ValueError, match="would change"):
        t.merge(more, "fail")
    with pytest.raises(ValueError):
        t.merge(more, "whatever")


def test_two_writers_at_once_lose_nothing(spark, tmp_path):
    Table(spark, str(tmp_path / "t"), ("id",)).merge(log(spark, ("a", 1, 1)))
    failed = []

    def write(i):
        try:
            Table(spark, str(tmp_path / "t"), ("id",)).merge(log(spark, (f"w{i}", i, 1), ("both", 9, 1), ("a", 2, 1)))
        except Exception as error:
            failed.append(error)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    t = Table(spark, str(tmp_path / "t"), ("id",))
    assert not failed and rows(t.read().select("id", "n")) == [("a", 2), ("both", 9), *[(f"w{i}", i) for i in range(4)]]
    assert t.versions.latest()[0] == 5


def test_partitions_are_overwritten_alone(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), partition="day")
    t.replace(log(spark, ("a", 1, 1), ("b", 2, 2), ("c", 3, 3)))
    before = {tuple(u) for u in t.versions.latest()[1]["units"]}
    t.overwrite_partitions(log(spark, ("x", 9, 2)))
    after = {tuple(u) for u in t.versions.latest()[1]["units"]}
    assert len(before & after) == 2 and rows(t.read().select("id")) == [("a",), ("c",), ("x",)]
    t.overwrite_partitions(log(spark, ("y", 1, 4)), covers=lambda day: day >= "2024-02-01", made="test")
    assert rows(t.read().select("id", "day")) == [("a", dt.date(2024, 1, 1)), ("y", dt.date(2024, 4, 1))] and t.note() == {"made": "test"}
    plan = t.read().filter(F.col("day") == dt.date(2024, 1, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    t.replace(log(spark))
    assert t.read().count() == 0 and t.read().columns == ["id", "n", "day"]


def test_a_load_that_breaks_off_changes_nothing(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.replace(log(spark, ("a", 1, 1)))
    broken = log(spark, ("b", 1, 1)).withColumn("n", F.when(F.col("id") == "b", F.raise_error(F.lit("broken"))).cast("long"))
    with pytest.raises(Exception, match="broken"):
        t.replace(broken)
    assert rows(t.read().select("id")) == [("a",)]
    t.replace(log(spark, ("c", 1, 1)))
    assert t.vacuum() == []  # too young
    assert len(t.vacuum(older_than_s=0)) == 2 and rows(t.read().select("id")) == [("c",)]
    assert t.versions.numbers() == [2]
