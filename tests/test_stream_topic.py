import pytest

from trustfold.streaming import topic
from trustfold.streaming.keyed import drain

SCHEMA = "key string, value string"


def messages(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(SCHEMA).parquet(f"{path}/in")


def got(spark, path):
    return sorted(map(tuple, topic.read_topic(spark, f"{path}/topic").collect()))


def test_batches_are_committed_once(spark, tmp_path):
    topic.register(spark)
    first = [("a", "1"), (None, "2"), ("c", None)]
    drain(messages(spark, tmp_path, first), f"{tmp_path}/c", topic.NAME, path=f"{tmp_path}/topic")
    drain(messages(spark, tmp_path, [("d", "4")]), f"{tmp_path}/c", topic.NAME, path=f"{tmp_path}/topic")
    want = [(0, *r) for r in first] + [(1, "d", "4")]
    key = lambda r: tuple(map(str, r))
    assert sorted(got_rows := [tuple(r) for r in topic.read_topic(spark, f"{tmp_path}/topic").collect()], key=key) == sorted(want, key=key) and len(got_rows) == 4


def test_a_batch_that_runs_again_appears_once(spark, tmp_path):
    """The second batch is written, but its commit in Spark's log is lost with the driver: the restart runs it again."""
    topic.register(spark)
    drain(messages(spark, tmp_path, [("a", "1")]), f"{tmp_path}/c", topic.NAME, path=f"{tmp_path}/topic")
    drain(messages(spark, tmp_path, [("b", "2"), ("c", "3")]), f"{tmp_path}/c", topic.NAME, path=f"{tmp_path}/topic")
    want = got(spark, tmp_path)
    for name in ("1", ".1.crc"):
        (tmp_path / "c" / "commits" / name).unlink(missing_ok=True)
    drain(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/c", topic.NAME, path=f"{tmp_path}/topic")
    assert got(spark, tmp_path) == want == [(0, "a", "1"), (1, "b", "2"), (1, "c", "3")]
    assert len(list((tmp_path / "topic" / "parts").iterdir())) > len({r[0] for r in want})  # the first try's parts lie there unlisted


def test_parts_without_a_commit_are_not_read_and_abort_removes_them(spark, tmp_path):
    import pyarrow as pa

    topic.register(spark)
    drain(messages(spark, tmp_path, [("a", "1")]), f"{tmp_path}/c", topic.NAME, path=f"{tmp_path}/topic")
    writer = topic.TopicWriter(f"file:{tmp_path}/topic")
    part = writer.write(iter([pa.RecordBatch.from_pydict({"key": ["x"], "value": ["y"]})]))
    assert part.rows == 1 and got(spark, tmp_path) == [(0, "a", "1")]
    writer.abort([part, None], 1)
    assert not (tmp_path / "topic" / "parts" / part.name).exists() and writer.write(iter([])).name is None


def test_other_frames_are_refused(spark, tmp_path):
    topic.register(spark)
    frame = messages(spark, tmp_path, [("a", "1")]).withColumnRenamed("key", "id")
    with pytest.raises(Exception, match="key and a value"):
        drain(frame, f"{tmp_path}/c", topic.NAME, path=f"{tmp_path}/topic")
