import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import vector_graph as G
from corpusmill.operators import vectors as V
from corpusmill.session import table


def unit(m):
    return (m / np.sqrt((m * m).sum(axis=1, keepdims=True))).astype(np.float32)


def test_walks_take_fewer_products_than_cells_for_the_same_recall():
    rng = np.random.default_rng(2)
    m = unit(rng.normal(size=(5000, 24)) + 1.2 * rng.normal(size=(60, 24))[rng.integers(0, 60, 5000)])
    q = unit(m[:200] + 0.05 * rng.normal(size=(200, 24)))
    exact = np.argsort(-(q @ m.T), axis=1)[:, :10]
    links = G.build(m, 16, 64)
    assert links.shape == (5000, 32) and (links < 5000).all() and not (links == np.arange(5000)[:, None]).any()
    recalls = []
    for ef in (10, 40, 160):
        places, _, taken = G.search(m, links, q, 10, ef, np.arange(0, 5000, 700))
        recalls.append(np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact.tolist(), places.tolist())]))
    assert recalls == sorted(recalls) and recalls[-1] >= 0.95
    places, _, taken = G.search(m, links, q, 10, 60, np.arange(0, 5000, 700))
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact.tolist(), places.tolist())])
    # Cells: centres by a few rounds of k-means, then the nearest ones are multiplied out until the recall is the same.
    centres = m[rng.permutation(5000)[:64]]
    for _ in range(8):
        cell = (m @ centres.T).argmax(axis=1)
        centres = unit(np.array([m[cell == c].sum(axis=0) if (cell == c).any() else centres[c] for c in range(64)]))
    cell, order = (m @ centres.T).argmax(axis=1), np.argsort(-(q @ centres.T), axis=1)
    for probes in range(1, 65):
        looked = np.zeros((200, 64), bool)
        np.put_along_axis(looked, order[:, :probes], True, axis=1)
        if np.mean([looked[i, cell[exact[i]]].mean() for i in range(200)]) >= recall:
            break
    products = 200 * 64 + sum(np.isin(cell, order[i, :probes]).sum() for i in range(200))
    assert recall >= 0.9 and taken < products, (recall, taken, products)


@pytest.mark.parametrize("block", [10_000, 200])
def test_recall_over_the_table(spark, block):
    emb = table(spark, "/root/testdata/sf0.01", "embeddings")
    asked = emb.where("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    exact = {(r.qid, r.id) for r in V.vector_search(asked, emb, id_col="vec_id", vector_col="embedding", k=10).collect()}
    index = G.GraphIndex(emb, id_col="vec_id", vector_col="embedding", block=block)
    assert index.table.count() == -(-500 // block)
    rows = index.search(asked, k=10, ef=64).collect()
    assert len(rows) == len(exact) == len({(r.qid, r.id) for r in rows})
    assert sum((r.qid, r.id) in exact for r in rows) >= 0.9 * len(exact)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [1.0]), (None, [1.0, 1.0]), (7, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "id int, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0])], "qid int, q array<double>")
    index = G.GraphIndex(frame, id_col="id", vector_col="v")
    assert [(r.qid, r.id) for r in index.search(asked, k=2).orderBy("rank").collect()] == [(1, 1), (1, 7)]
    assert G.GraphIndex(frame.limit(0), id_col="id", vector_col="v").search(asked, k=2).collect() == []


def test_a_block_is_built_in_little_memory():
    import tracemalloc

    m = unit(np.random.default_rng(4).normal(size=(3000, 16)))
    tracemalloc.start()
    links = G.build(m, 8, 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links.shape == (3000, 16)
    assert peak < 2.5 * 4 * G._ROWS * len(m)  # a product of 1,024 rows and what orders some of them
