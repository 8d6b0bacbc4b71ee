import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import hardneg
from corpusmill.llm.queries import OP12_SQL, op12_hard_negatives
from tests.llm.oracle import compare, connect

SCHEMA = "vec_id long, label int, embedding array<float>, rank string, id int"


def plain(rows, every=5, positives=5, negatives=3):
    """Every row with every anchor, in Python's whole numbers."""
    best = {}
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        item = (label, [float(np.float32(x)) for x in v])
        best[i] = min(best.get(i, item), item)
    live = [(i, label, [math.floor(256 * x) for x in v]) for i, (label, v) in best.items()]
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -(2**63) + 1), 2**63 - 1)
    out = set()
    for i, label, v in live:
        if i % every:
            continue
        ranked = sorted((-score(v, w), j, other) for j, other, w in live if j != i)
        for p, j, _ in [r for r in ranked if r[2] == label][:positives]:
            fine = [r for r in ranked if r[2] != label and -50 * p <= -100 * r[0] <= -95 * p][:negatives]
            out |= {(i, j, n, k, -p, -s) for n, (s, k, _) in enumerate(fine, 1)}
    return out


def rows_of(rng, n, dims, labels=3, clusters=4):
    centres = [[rng.uniform(-0.5, 0.5) for _ in range(dims)] for _ in range(clusters)]
    made = []
    for i in range(n):
        c = rng.choice(centres)
        made.append((i, rng.randrange(labels), [x + rng.uniform(-0.15, 0.15) for x in c]))
    return made


def run(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    out = [tuple(r) for r in hardneg.mine(frame, F.col("vec_id") % 5 == 0, **how).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("how", [{}, {"tree_bytes": 4000, "block_bytes": 2000}])
def test_all_scores(spark, how):
    rng = random.Random(7)
    rows = rows_of(rng, 400, 6)
    rows += [(1000 + i, i % 3, rows[3][2]) for i in range(300)]  # copies of one vector: ties by id
    assert run(spark, rows, **how) == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(8)
    rows = rows_of(rng, 40, 4)
    rows += [(None, 1, [0.5] * 4), (41, None, [0.5] * 4), (42, 1, None), (43, 1, [0.5, None, 0.5, 0.5]), (44, 1, [float("nan")] * 4), (45, 2, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(50, 1, [0.5, 0.25]), (55, 2, []), (60, 1, [0.1] * 9), (65, 0, [3e38] * 4), (70, 0, [-3e38] * 4), (71, 1, [2e38] * 4), (72, 2, [1.1e38] * 4)]
    rows += [rows[5], (10, 9, [0.1] * 4), (10, 0, [0.2] * 4), (11, 0, [0.9] * 4), (-5, 1, [0.3] * 4), (-10, 2, [-0.3] * 4)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == set()
    assert run(spark, [(7, 1, [0.5])]) == set()


def test_trees_leave_out_nodes_and_lose_nothing():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 60
    x = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 8)) * 4)
    ids, labels = rng.permutation(6000), rng.integers(0, 4, 6000)
    tree = hardneg.BallTree.build(x, ids, labels)
    q, own = x[:200], ids[:200]
    exact = (q @ x.T).astype(np.int64)
    for same in (True, False):
        high = exact.max(axis=1) * 3 // 4
        s = hardneg.Searches(q, np.arange(200), own, labels[:200], high // 2, high, same)
        best = hardneg.Best(200, 3)
        assert hardneg.search(tree, s, best, chunk=64) < 200 * 6000 / 2
        for i in range(200):
            fine = [(-int(exact[i, j]), int(ids[j])) for j in range(6000) if (labels[j] == labels[i]) == same and ids[j] != own[i] and high[i] // 2 <= exact[i, j] <= high[i]]
            want = sorted(fine)[:3]
            got = [(-int(a), int(b)) for a, b in zip(best.scores[i], best.ids[i]) if a != hardneg._NONE]
            assert got == want


def test_windows():
    for p in range(-500, 500):
        low, high = hardneg.window(p)
        assert [n for n in range(-600, 600) if 50 * p <= 100 * n <= 95 * p] == list(range(low, high + 1))


def test_sql(spark):
    assert compare(op12_hard_negatives(spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), OP12_SQL) > 50
