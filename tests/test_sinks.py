import pytest
from pyspark.sql import functions as F

from corpusmill.sources import remote, sinks
from corpusmill.streaming import streams

SECTION = "slug string, source string, seq int, enbez string, title string, text string"


def test_laws_are_swapped_whole_or_not_at_all(spark, tmp_path):
    store = sinks.LawStore(spark, str(tmp_path / "laws"))
    frame = lambda rows: spark.createDataFrame(rows, SECTION)
    held = lambda: sorted((r.slug, r.seq, r.text) for r in store.sections().collect())
    assert held() == []
    first = [("a", "u", 0, "§ 1", None, "one"), ("a", "u", 1, "Anlage", "x", None), ("b", "u", 0, "§ 1", None, "two")]
    assert sorted((r.slug, r.n_sections, r.n_paragraphs) for r in store.write(frame(first)).collect()) == [("a", 2, 1), ("b", 1, 1)]
    assert store.write(frame(first[::-1])).collect() == []  # nothing has changed
    assert [p.name for p in (tmp_path / "laws" / "sections").iterdir() if p.name.startswith("version")] == ["version=1"]
    assert [r.slug for r in store.write(frame([("a", "u", 0, "§ 1", None, "changed"), first[2]])).collect()] == ["a"]
    assert held() == [("a", 0, "changed"), ("b", 0, "two")]  # the second section of a is gone
    broken = frame(first).withColumn("text", F.when(F.col("slug") == "b", F.raise_error(F.lit("a task fails"))).otherwise(F.lit("half")))
    with pytest.raises(Exception, match="a task fails"):
        store.write(broken)
    # Files that a failed write has left are of a version that the ledger doesn't name.
    frame(first).withColumn("sha256", F.lit("x")).write.partitionBy("slug").json(str(tmp_path / "laws" / "sections" / "version=3"))
    assert held() == [("a", 0, "changed"), ("b", 0, "two")]
    store.write(frame([("c", "u", 0, "§ 9", None, "three")]))
    assert held() == [("a", 0, "changed"), ("b", 0, "two"), ("c", 0, "three")]


def test_backup_and_restore(spark, tmp_path):
    table = spark.createDataFrame([(1, "a", [1.5]), (2, None, None), (None, "c", [2.0])], "k int, v string, w array<double>")
    path = str(tmp_path / "b")
    assert sinks.backup(table, path)["rows"] == 3
    key = lambda r: str(r)
    rows = lambda df: sorted(map(tuple, df.collect()), key=key)
    assert rows(sinks.restore(None, path, ["k"], spark)) == rows(table)
    now = spark.createDataFrame([(1, "lost", None), (None, "lost", None), (9, "kept", None)], table.schema)
    assert rows(sinks.restore(now, path, ["k"], spark)) == sorted([*map(tuple, table.collect()), (9, "kept", None)], key=key)
    table.limit(1).write.mode("append").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="manifest"):
        sinks.restore(now, path, ["k"], spark)


def test_batches_run_twice_change_nothing(spark, tmp_path):
    table = streams.TopUp(spark, str(tmp_path / "t"), "id")
    frame = lambda ids: spark.createDataFrame([(i,) for i in ids], "id bigint")
    assert table.rows("id bigint").collect() == [] if (tmp_path / "t/rows").exists() else True
    table.put(frame([1, 5]), 0)
    table.put(frame([]), 1)
    frame([77]).write.parquet(str(tmp_path / "t/rows/batch=2"))  # a batch that failed before its ledger row
    assert sorted(r.id for r in table.rows("id bigint").collect()) == [1, 5]
    table.put(frame([7]), 2)
    table.put(frame([100]), 0)  # run again
    assert sorted(r.id for r in table.rows("id bigint").collect()) == [1, 5, 7]
    assert sorted((r.batch, r.rows, r.mark) for r in table.ledger().collect()) == [(0, 2, 5), (1, 0, None), (2, 1, 7)]


def test_keys_are_asked_once_over_restarts(spark, tmp_path):
    keys, out = tmp_path / "keys", str(tmp_path / "out")
    spark.range(3000).select(F.col("id").alias("key")).repartition(3).write.parquet(str(keys))

    def go():
        stream = remote.fetched(spark.readStream.schema("key bigint").parquet(str(keys)), "corpusmill.sources.remote:offline", tasks=2)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)

    assert go().count() == 3000
    spark.createDataFrame([(5000,)], "key bigint").write.mode("append").parquet(str(keys))
    again = go()
    assert again.count() == 3001 == again.select("key").distinct().count()


def test_tiles(spark):
    boxes = spark.createDataFrame([(1, 50.0, 8.0, 50.25, 8.1), (2, 50.0, 8.0, 50.0, 8.0)], "id int, south double, west double, north double, east double")
    rows = remote.tiled(boxes, 0.1).collect()
    assert sorted((r.id, r.row, r.col) for r in rows) == [(1, 0, 0), (1, 1, 0), (1, 2, 0), (2, 0, 0)]
    one = [r for r in rows if r.id == 1]
    assert max(r.north - r.south for r in one) <= 0.1 + 1e-9 and (min(r.south for r in one), max(r.north for r in one)) == (50.0, 50.25)
