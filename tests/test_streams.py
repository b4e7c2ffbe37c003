"""Change streams: each stateful operator over several batches, against its batch form."""

import datetime

import pytest
from pyspark.sql import functions as F

from codeloom.engine import Repository
from codeloom.streaming import changes

@pytest.fixture(autouse=True)
def one_partition(spark):
    """Every partition of a stateful operator has a store of its own to keep."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


T0 = datetime.datetime(2024, 1, 1)


def at(ms):
    return T0 + datetime.timedelta(milliseconds=ms)


def batches(spark, tmp_path, parts, make, output="append"):
    """Rows of a stream over one JSON file a batch."""
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    out = []
    query = None
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, changes.EVENTS).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(changes.EVENTS).option("maxFilesPerTrigger", 1).json(str(source))
    query = make(stream).writeStream.outputMode(output).option("checkpointLocation", str(sink / "state")).foreachBatch(lambda df, _: out.extend(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return out


def event(ms, path, kind="modified", content=None, old=None):
    return (at(ms), path, kind, old, content)


def test_leading_edge(spark, tmp_path):
    parts = [[event(0, "a.py"), event(100, "a.py"), event(600, "a.py"), event(50, "b.py")], [event(900, "a.py"), event(1100, "a.py"), event(20_000, "c.py")], [event(40_000, "a.py"), event(40_200, "a.py")]]
    got = batches(spark, tmp_path, parts, lambda s: changes.debounced_leading(s, 0.5))
    assert sorted((r.path, r.ts) for r in got) == [("a.py", at(0)), ("a.py", at(600)), ("a.py", at(1100)), ("a.py", at(40_000)), ("b.py", at(50)), ("c.py", at(20_000))]
    rows = spark.createDataFrame([e for p in parts for e in p], changes.EVENTS)
    batch = changes.debounced_leading_batch(rows, "path", "ts", 500_000)
    assert sorted((r.path, r.micros) for r in batch.collect()) == sorted((r.path, int((r.ts - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6)) for r in got)


def test_classification(spark, tmp_path):
    parts = [
        [event(0, "known.py", "created", "1"), event(1, "new.py", "modified", "2"), event(2, "ghost.py", "deleted"), event(3, "new.py", "created", "3")],
        [event(10, "new.py", "deleted"), event(11, "new.py", "created", "4"), event(12, "moved.py", "renamed", "5", "known.py"), event(13, "known.py", "modified", "6")],
    ]
    known = spark.createDataFrame([("known.py",)], "path string")
    got = [(r.path, r.ts, r.meaning) for r in batches(spark, tmp_path, parts, lambda s: changes.classified_stream(s, known))]
    assert sorted(got) == sorted(
        [("known.py", at(0), "modified"), ("new.py", at(1), "created"), ("ghost.py", at(2), "ignored"), ("new.py", at(3), "modified"), ("new.py", at(10), "deleted"), ("new.py", at(11), "created"), ("known.py", at(12), "deleted"), ("moved.py", at(12), "created"), ("known.py", at(13), "created")]
    )


def test_sessions(spark, tmp_path):
    parts = [[event(0, "a.py"), event(60, "a.py"), event(500, "a.py")], [event(60_000, "z.py")]]
    got = batches(spark, tmp_path, parts, changes.debounced_sessions)
    assert {(r.path, r.first, r.n) for r in got if r.path == "a.py"} == {("a.py", at(0), 2), ("a.py", at(500), 1)}


def test_repository_follows_a_folder(spark, tmp_path, make_files):
    root, feed = tmp_path / "repo", tmp_path / "feed"
    (root / "sub").mkdir(parents=True)
    feed.mkdir()
    (root / "a.py").write_text("import b\n")
    (root / "b.py").write_text("x = 1\n")
    (root / ".codeloom.toml").write_text('[project]\nsource_roots = ["./sub/"]\n')
    repo = Repository.read(spark, str(root))
    assert repo.source_roots == ("sub",) and {(r.src, r.dst) for r in repo.edges.collect()} == {("a.py", "b.py")}
    before = changes.poll(spark, str(root), str(feed), repo.files, "2024-01-01 00:00:00")
    (root / "b.py").unlink()
    (root / "a.py").write_text("import c\n")
    (root / "sub" / "c.py").write_text("y = 1\n")
    (root / "note.txt").write_text("no")
    now = changes.poll(spark, str(root), str(feed), before, "2024-01-01 00:00:10")
    assert now.count() == 4
    query = repo.follow(changes.watch(spark, str(feed)), str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    assert {(r.src, r.dst) for r in repo.edges.collect()} == {("a.py", "sub/c.py")}


def test_counters(spark):
    events = spark.createDataFrame([event(0, "a.py"), event(1, None)], changes.EVENTS)
    assert changes.stats(events).count() == 2
    assert [r.meaning for r in changes.classified(events.filter("path is not null").withColumn("seq", F.lit(1)), None).collect()] == ["created"]


@pytest.mark.parametrize("gap,want", [(0, 3), (10**9, 1)])
def test_gaps(spark, gap, want):
    rows = spark.createDataFrame([event(0, "a"), event(0, "a"), event(5, "a"), (None, "a", "modified", None, None)], changes.EVENTS)
    assert changes.debounced_leading_batch(rows, "path", "ts", gap).count() == want
