"""Polygon joins in which many places have one ring."""

from corpusmill.operators import spatial as SP


def square(lat, lng, half):
    return [[lat - half, lng - half], [lat - half, lng + half], [lat + half, lng + half], [lat + half, lng - half]]


def test_equal_rings_are_compared_once_and_all_pairs_come_back(spark):
    schema = "id long, ring array<array<double>>"
    left = spark.createDataFrame([(i, square(48.0 + i % 3, 9.0, 0.1)) for i in range(60)] + [(1, square(50.0, 9.0, 0.1)), (None, square(48.0, 9.0, 0.1)), (99, None)], schema)
    right = spark.createDataFrame([(i, square(48.05 + i % 2, 9.05, 0.1)) for i in range(20)], schema).toDF("area_id", "area")
    members, shapes = SP._shapes(left, "id", "ring", "a")
    assert shapes.count() == 3 and members.count() == 62
    found = SP.polygon_join(left, right, left_id="id", left_ring="ring", right_id="area_id", right_ring="area").collect()
    at = {0: [*range(0, 60, 3), None], 1: [*range(1, 60, 3)]}
    assert sorted(found, key=repr) == sorted(((i, j) for j in range(20) for i in at[j % 2]), key=repr)


def test_pairs_of_rings_that_many_have_take_little_room(spark, tmp_path):
    from pyspark.sql import functions as F

    ids = lambda n, name: spark.range(n).select((F.col("id") * 7_919 % 1_000_003).alias(name), F.lit(None).alias("x"))
    at = lambda lat: F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in square(lat, 9.0, 0.1)])
    left = ids(3_003, "id").select("id", at(48.0).alias("ring")).unionByName(spark.range(5).select(F.lit(None).cast("long").alias("id"), at(52.0).alias("ring")))
    right = ids(701, "area_id").select("area_id", at(48.05).alias("area")).unionByName(ids(20, "area_id").select("area_id", at(52.05).alias("area")))
    SP.polygon_join(left, right, left_id="id", left_ring="ring", right_id="area_id", right_ring="area").write.parquet(f"{tmp_path}/pairs")
    found = spark.read.parquet(f"{tmp_path}/pairs")
    assert found.count() == 3_003 * 701 + 5 * 20 and found.distinct().count() == 3_003 * 701 + 20
    assert found.where("id is null").groupBy("area_id").count().where("count = 5").count() == 20
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.4 * 3_003 * 701


def test_runs_are_multiples_of_eight_but_for_the_rest(spark):
    from pyspark.sql import functions as F

    sizes = (0, 1, 7, 8, 12, 256, 257, 300, 1024, 1031)
    got = spark.createDataFrame([(n, list(range(n))) for n in sizes], "n int, ids array<int>").select("n", SP._runs(F.col("ids")).alias("runs")).collect()
    for r in got:
        assert [x for run in r.runs for x in run] == list(range(r.n)) and all(0 < len(run) <= SP.RUN for run in r.runs)
        assert all(len(run) % 8 == 0 for run in r.runs[:-1]) and sum(len(run) % 8 > 0 for run in r.runs) == (r.n % 8 > 0)


def test_hulls_are_rimmed_in_one_step_on_all_cores(spark):
    import math

    from pyspark.sql import functions as F

    from corpusmill import plans
    from corpusmill.functions import geo as G

    points = [[48.0, 9.0], [48.01, 9.0], [48.0, 9.01], [48.002, 9.002]]
    spread = [[p[0] + 0.005 * math.cos(2 * math.pi * i / 64), p[1] + 0.005 * math.sin(2 * math.pi * i / 64)] for i in range(64) for p in points]
    df = spark.createDataFrame([(points, spread), (None, None)], "points array<array<double>>, spread array<array<double>>")
    rimmed = df.select(G.buffered_hull(F.col("points")).alias("a"), G.convex_hull("spread").alias("b")).collect()
    assert all(r.a == r.b for r in rimmed) and len(rimmed[0].a) > 60
    assert plans.QUERIES["g3_g4_project_areas"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_amounts_are_read_from_the_last_cell_on(spark, monkeypatch):
    from pyspark.sql import functions as F

    from corpusmill.operators import tables as T

    rows = [(["Posten 3", "1.234,50 €"],), (["7", "x", ""],), (["x"],), ([],), (None,), ([None, "5", None],)]
    df = spark.createDataFrame(rows, "cells array<string>")
    assert [r[0] for r in df.select(T.row_amount(F.col("cells"))).collect()] == [1234.5, 7.0, None, None, None, 5.0]
    monkeypatch.setattr(T.V, "german_number", lambda c: F.when(c == "9", F.raise_error(F.lit("read"))).otherwise(c.try_cast("double")))
    assert spark.createDataFrame([(["9", "5", "x"],)], "cells array<string>").select(T.row_amount(F.col("cells"))).first()[0] == 5.0


def test_names_are_shuffled_once_for_their_trigrams(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    from corpusmill.operators import setjoin as S

    plans, write = {}, DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.update({path.split("/")[-1]: self._df._jdf.queryExecution().executedPlan().toString()}), write(self, path, *a, **k))[1])
    monkeypatch.setattr(S, "NAMES", 10)
    names = spark.createDataFrame([(i // 2, f"Customer {i}") for i in range(200)], "id int, name string")
    index = S.TrigramIndex(spark, str(tmp_path / "i"), 0.5, buckets=4).build(names, id_col="id", name_col="name")
    assert plans["postings"].count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plans["postings"]
    assert "ASC NULLS FIRST, 20), REPARTITION_BY_NUM" in plans["postings"]
    needles = spark.createDataFrame([(1, "customer 7")], "qid int, needle string")
    assert "SortMergeJoin" not in index.candidates(needles)._jdf.queryExecution().executedPlan().toString()
    assert 3 in {r.id for r in index.search(needles).collect()}


def test_a_parsed_document_is_read_once_for_all_its_parts(spark, monkeypatch):
    import json

    from corpusmill.sources import readers as S

    plans, cut = [], S.checkpointed
    monkeypatch.setattr(S, "checkpointed", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    ref = lambda *names: [{"$ref": f"#/{n}"} for n in names]
    doc = {"texts": [{"label": "section_header", "text": "Kapitel"}, {"text": "Inhalt"}], "pictures": [{"captions": [{"text": "Bild 1"}]}], "groups": [{"children": ref("texts/1", "groups/1")}, {"children": ref("pictures/0")}], "body": {"children": ref("body/0", "texts/0", "groups/0", "texts/9")}}
    given = [(1, json.dumps(doc)), (2, None), (3, "no json"), (None, json.dumps(doc)), (4, json.dumps({"texts": [{"text": "allein"}]})), (5, json.dumps({"body": {"children": ref("texts/0")}, "texts": [{"text": "Absatz"}]}))]
    found = S.document_tree(spark.createDataFrame(given, "id int, doc string"), "id", "doc")
    rows = sorted((r.id, r.place, r.text, r.section, r.type) for r in found.collect())
    assert rows == [(1, 1, "Kapitel", "Kapitel", "text"), (1, 2, "Inhalt", "Kapitel", "text"), (1, 3, "Bild 1", "Kapitel", "picture"), (5, 1, "Absatz", "General", "text")]
    assert "Union" not in plans[0]
