import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from eddyline.operators.dedup import latest_per_key
from eddyline.session import scratch_dir
from eddyline.sources.batches import BatchFolders
from eddyline.streaming.run import read_result
from eddyline.streaming.sinks import upsert_sink

SCHEMA = StructType([StructField("k", StringType()), StructField("v", LongType())])


@pytest.fixture
def folders(spark):
    return BatchFolders(spark, scratch_dir(spark, "batches"), fan=3)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def total(folders):
    return {r["k"]: r["v"] for r in folders.rows(SCHEMA).groupBy("k").agg(F.sum("v").alias("v")).collect()}


def by_key(df):
    return df.groupBy("k").agg(F.sum("v").cast("long").alias("v"))


def test_commit_replace_and_compact(spark, folders):
    assert folders.rows(SCHEMA).count() == 0
    for i in range(10):
        folders.commit(i, frame(spark, ("a", i), (None, 1)))
        folders.commit(i, frame(spark, ("a", i), (None, 1)))          # a replay
        folders.compact(by_key, SCHEMA)
    assert total(folders) == {"a": 45, None: 10}
    assert sorted(e["level"] for e in folders.live()) == [0, 2]
    folders.commit(2, frame(spark, ("a", 2), (None, 1)))              # merged by now
    assert total(folders) == {"a": 45, None: 10}
    folders.commit(9, frame(spark, ("a", 100)))
    assert total(folders) == {"a": 136, None: 9}


def test_failed_commit_changes_nothing(spark, folders):
    folders.commit("one", frame(spark, ("a", 1)))
    bad = frame(spark, ("a", 5), ("b", 7)).select("k", F.expr("IF(k = 'b', raise_error('lost'), v)").cast("long").alias("v"))
    with pytest.raises(Exception, match="lost"):
        folders.commit("two", bad)
    with pytest.raises(Exception, match="lost"):
        folders.commit("one", bad)
    assert total(folders) == {"a": 1}
    folders.commit("two", frame(spark, ("a", 5), ("b", 7)))
    assert total(folders) == {"a": 6, "b": 7}


def test_reader_of_the_version_before(spark, folders):
    folders.commit(0, frame(spark, ("a", 1)))
    old = folders.rows(SCHEMA)
    folders.commit(0, frame(spark, ("a", 2)))
    assert old.count() == 1 and total(folders) == {"a": 2}
    folders.commit(1, frame(spark, ("a", 3)))
    names = [f.getPath().getName() for f in folders._fs.listStatus(folders._path(folders.path))]
    assert sum(not n.startswith("_") for n in names) == 2             # the dropped folder is gone


def test_alone_keeps_the_last_batch(spark, folders):
    for i in range(3):
        folders.commit(i, frame(spark, ("a", i)), alone=True)
    assert [e["batches"] for e in folders.live()] == [["2"]] and total(folders) == {"a": 2}


def test_upsert_before_and_after_compaction(spark):
    path = scratch_dir(spark, "upserts")
    sink = upsert_sink(path, keys=["k"], fan=3)
    for i in range(8):
        sink(frame(spark, ("a", i), (f"k{i}", i)), i)
        sink(frame(spark, ("a", i), (f"k{i}", i)), i)
        got = {r["k"]: r["v"] for r in read_result(spark, SCHEMA, path, "update", ["k"]).collect()}
        assert got == {"a": i, **{f"k{j}": j for j in range(i + 1)}}
    assert len(BatchFolders(spark, path).live()) == 4                  # 3 + 3 + 1 + 1
    sink(frame(spark, ("a", 1)), 1)
    assert {r["v"] for r in read_result(spark, SCHEMA, path, "update", ["k"]).filter("k = 'a'").collect()} == {7}


def test_complete_reads_its_last_folder_only(spark):
    path = scratch_dir(spark, "complete")
    sink = upsert_sink(path, complete=True)
    for i in range(3):
        sink(frame(spark, ("a", i)), i)
    got = read_result(spark, SCHEMA, path, "complete")
    assert [tuple(r) for r in got.collect()] == [("a", 2)]
    assert len(got.inputFiles()) == len([f for f in got.inputFiles() if "/2." in f])
    assert latest_per_key(got, ["k"], ["v"]).count() == 1
