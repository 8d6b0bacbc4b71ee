import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import writes
from corpusmill.streaming import state

START = datetime(2024, 1, 1)


def drained(spark, rows, schema, cuts, make, tmp_path, mode="append"):
    """Runs a stream over rows cut into batches, a file for each, in order; returns what it gave."""
    import time

    source, out = tmp_path / "in", str(tmp_path / "out")
    frame = spark.createDataFrame(rows, schema)
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(source / f"b{n:03}"))
        time.sleep(0.01)
    keep = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(source / "b*"))
    with state.rocksdb(spark):
        query = make(stream).writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def histories(rng, n):
    rows, at = [], 0
    names = ["queued", "processing", "done", "failed"]
    for ord_ in range(1, 7):
        for key in range(n):
            at += 1
            name = "queued" if ord_ == 1 and rng.random() < 0.9 else rng.choice(names)
            rows.append((key, ord_, START + timedelta(seconds=at), name, "e" * 600 if name == "failed" else None, rng.randint(0, 9)))
    return rows


@pytest.mark.parametrize("cuts", [[], [7, 20, 21]])
def test_ingestion_is_the_same_for_any_cut(spark, tmp_path, cuts):
    schema = "key int, ord int, ts timestamp, state string, error string, pages int"
    rows = histories(random.Random(5), 6)
    found = state.latest(drained(spark, rows, schema, cuts, lambda s: state.ingestion(s), tmp_path, "update"))
    columns = ["key", "state", "error", "pages_done", "refused", "enqueue"]
    want = writes.ingestion(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_unfinished_documents_go_back_to_the_queue(spark, tmp_path):
    schema = "key int, ord int, ts timestamp, state string, error string, pages int"
    rows = [(1, 1, START, "queued", None, 0), (1, 2, START, "processing", None, 4), (2, 1, START, "queued", None, 0), (2, 2, START, "processing", None, 1), (2, 3, START, "done", None, 9)]
    rows += [(9, 1, START + timedelta(hours=5), "queued", None, 0), (9, 2, START + timedelta(hours=5, minutes=1), "done", None, 0), (8, 1, START + timedelta(hours=5, minutes=2), "queued", None, 0)]
    out = drained(spark, rows, schema, [5, 6, 7], lambda s: state.ingestion(s, lease_ms=3_600_000), tmp_path, "update")
    again = [r for r in out.collect() if r.requeued]
    assert [(r.key, r.state, r.pages_done, r.enqueue) for r in again] == [(1, "queued", 0, True)]
    assert {r.key: r.state for r in state.latest(out).collect()}[2] == "done"


def test_caches_expire(spark, tmp_path):
    schema = "key string, ts timestamp, value string, expires timestamp"
    at = lambda h: START + timedelta(hours=h)
    rows = [("a", at(0), "v1", at(2)), ("b", at(0), "x", None), ("c", at(0), "y", at(50)), ("a", at(1), None, None), ("b", at(1), None, None)]
    rows += [("a", at(3), None, None), ("c", at(3), None, None), ("d", at(3), None, None), ("a", at(4), "v2", at(9)), ("a", at(5), None, None), ("a", at(9), None, None), ("c", at(49), None, None), ("c", at(51), None, None), ("a", at(52), None, None)]
    out = drained(spark, rows, schema, [5, 8, 10, 12], lambda s: state.expiring(s), tmp_path)
    got = {(r.key, r.ts): (r.hit, r.value) for r in out.collect()}
    assert len(got) == 10
    for (key, ts), found in got.items():
        before = [r for r in rows if r[2] is not None and r[0] == key and r[1] <= ts]
        cache = spark.createDataFrame([(k, v, e) for k, _, v, e in before[-1:]], "key string, value string, expires timestamp")
        want = writes.cached(spark.createDataFrame([(key,)], "key string"), cache, F.lit(ts)).first()
        assert found == (want.hit, want.value), (key, ts)


def test_cadence(spark, tmp_path):
    rows = [(i % 3, i) for i in range(20)]
    out = drained(spark, rows, "session int, turn int", [4, 5, 13], lambda s: state.cadence(s), tmp_path)
    assert sorted(map(tuple, out.collect())) == [(s, n) for s in range(3) for n in (3, 6)]
