import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from corpusmill.operators import lexical, retrieval


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return [" ".join(rng.choices(words, weights=range(1, 41), k=rng.randint(0, 30))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.select("qid", "id", "score", "rank").collect())


@pytest.fixture()
def queries(spark):
    return spark.createDataFrame([(1, ["w3", "w9", "w39", "w39"]), (2, ["w1"]), (3, ["unseen"]), (4, [f"w{i}" for i in range(40)]), (5, None), (6, ["w38", "neu"])], "qid long, terms array<string>")


def scan(queries, docs, k=5):
    return rows(retrieval.bm25(queries.where("terms is not null"), docs, id_col="doc_id", text_col="text", k=k))


def test_additions_and_removals(spark, queries, tmp_path):
    now = dict(enumerate(texts(1, 300)))
    index = lexical.LexicalIndex(spark, str(tmp_path / "i"), buckets=8, block=16)
    assert index.top_k(queries, 5).collect() == []
    index.add(frame(spark, list(now.items())), id_col="doc_id", text_col="text")
    assert rows(index.top_k(queries, 5)) == scan(queries, frame(spark, list(now.items())))

    more = {1000 + i: t for i, t in enumerate(texts(2, 80))} | {7: "neu neu w38", 8: ""}
    index.add(frame(spark, list(more.items())), id_col="doc_id", text_col="text")
    now |= more
    assert rows(index.top_k(queries, 5)) == scan(queries, frame(spark, list(now.items())))

    gone = [7, 1001, 5000, *range(100, 160)]
    assert index.remove(spark.createDataFrame([(i,) for i in gone], "id long")) == 62
    now = {i: t for i, t in now.items() if i not in gone}
    assert index.remove(spark.createDataFrame([(7,)], "id long")) == 0
    again = lexical.LexicalIndex(spark, str(tmp_path / "i"), buckets=99)
    assert again.buckets == 8
    assert rows(again.top_k(queries, 5)) == scan(queries, frame(spark, list(now.items())))
    for few in (0, 10**9):  # by bounds of blocks, and all at once
        assert rows(again.top_k(queries, 5, few=few, first=2)) == scan(queries, frame(spark, list(now.items())))
    assert rows(again.top_k(queries, 1000)) == scan(queries, frame(spark, list(now.items())), 1000)
    assert sorted((r.qid, r.id, r.score) for r in again.scores(queries).collect()) == [r[:3] for r in scan(queries, frame(spark, list(now.items())), 1000)]
    again.add(frame(spark, [(7, "w39 back")]), id_col="doc_id", text_col="text")
    assert rows(again.top_k(queries, 5)) == scan(queries, frame(spark, [*now.items(), (7, "w39 back")]))


def test_odd_rows_and_unnamed_segments(spark, queries, tmp_path):
    index = lexical.LexicalIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(frame(spark, [(None, "w1"), (1, None), (2, "w1 w1"), (2, "w1 w3"), (3, "w1 " * 20_000)]), id_col="doc_id", text_col="text")
    want = scan(queries, frame(spark, [(1, ""), (2, "w1 w1"), (3, "w1 " * 20_000)]))
    assert rows(index.top_k(queries, 5)) == want
    # A write that failed before the ledger left files that nobody reads, and the next one takes their place.
    spark.read.parquet(f"{index.folder}/postings/segment=0").write.partitionBy("bucket").parquet(f"{index.folder}/postings/segment=1")
    assert rows(index.top_k(queries, 5)) == want
    index.add(frame(spark, [(9, "w3")]), id_col="doc_id", text_col="text")
    assert rows(index.top_k(queries, 5)) == scan(queries, frame(spark, [(1, ""), (2, "w1 w1"), (3, "w1 " * 20_000), (9, "w3")]))
    index.add(frame(spark, []), id_col="doc_id", text_col="text")
    assert rows(index.top_k(queries, 5))[0][0] == 1


def test_only_the_buckets_of_the_terms_are_read(spark, tmp_path):
    index = lexical.LexicalIndex(spark, str(tmp_path / "i"), buckets=64, block=8)
    index.add(frame(spark, list(enumerate(texts(3, 200)))), id_col="doc_id", text_col="text")
    asked = spark.createDataFrame([(1, ["w3", "w9"])], "qid long, terms array<string>")
    plan = index.top_k(asked, 3, few=0)._jdf.queryExecution().toString()
    wanted = {r.b for r in asked.select(F.explode("terms").alias("term")).select(lexical._bucket("term", 64).alias("b")).collect()}
    reads = [line for line in plan.splitlines() if "PartitionFilters" in line and "docs#" in line]
    assert reads and all("bucket" in line.split("PartitionFilters")[1] for line in reads)
    files = index.postings().where(F.col("bucket").isin(*wanted)).select("_metadata.file_path").distinct().count()
    assert files < index.postings().select("_metadata.file_path").distinct().count() / 4


def test_an_index_is_kept_for_the_files_as_they_are(spark, tmp_path, queries):
    path = str(tmp_path / "t")
    frame(spark, [(1, "w1")]).write.parquet(path)
    seen = lexical.snapshot(spark.read.parquet(path))
    open_ = lambda: lexical.index_of(spark, str(tmp_path / "x"), spark.read.parquet(path), id_col="doc_id", text_col="text", source=lexical.snapshot(spark.read.parquet(path)))
    assert open_().top_k(queries, 5).count() == 2
    assert lexical.snapshot(spark.read.parquet(path)) == seen and len(open_()._ledger()) == 1
    frame(spark, [(2, "w1")]).write.mode("append").parquet(path)
    assert lexical.snapshot(spark.read.parquet(path)) != seen
    assert open_().top_k(queries, 5).count() == 4


def test_tokens_of_a_text_are_counted_in_place(spark):
    given = ["b a b", "", "x", "A a, a-ß ß", None]
    df = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").select("doc_id", lexical.counted(F.coalesce("text", F.lit(""))).alias("c"))
    got = {r.doc_id: (r.c.len, r.c.terms, r.c.tfs) for r in df.collect()}
    assert got == {0: (3, ["a", "b"], [1, 2]), 1: (0, [], []), 2: (1, ["x"], [1]), 3: (5, ["a", "ß"], [3, 2]), 4: (0, [], [])}
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_shuffled_once_as_they_are_written(spark, tmp_path, monkeypatch):
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.append((path, self._df._jdf.queryExecution().executedPlan().toString())), write(self, path, *a, **k))[1])
    monkeypatch.setattr(lexical, "checkpointed", lambda df: pytest.fail("a copy of the texts or postings is kept"))
    lexical.LexicalIndex(spark, str(tmp_path / "i"), buckets=4, block=16).add(frame(spark, list(enumerate(texts(1, 100)))), id_col="doc_id", text_col="text")
    (plan,) = [p for path, p in plans if "/postings/" in path]
    assert plan.count("Exchange") == 1
