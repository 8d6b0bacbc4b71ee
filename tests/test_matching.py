import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import matching, setjoin, spatial
from corpusmill.operators.retrieval import trigram_similarity
from corpusmill.plans.places import fuzzy_sides
from corpusmill.plans.registry import Tables


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def plain_score(p, r):
    if p[0] is not None and p[0] == r[0]:
        return 1.0
    same, field = p[1] is not None and p[1] == r[1], p[2] is not None and p[2] == r[2]
    if same and field:
        return 0.9 if not p[3] or not r[3] else 0.7 + 0.3 * ratio(p[3], r[3])
    if same:
        return 0.5
    return None if p[0] is None or r[0] is None else ratio(p[0], r[0])


def plain_matches(parcels, refs, least):
    best = {}
    for p in parcels:
        for r in refs:
            s = plain_score(p, r)
            if p[0] is not None and s is not None and s >= least:
                best[p[0]] = max(best.get(p[0], (0, 0, "")), (s, -r[4], r[0]), key=lambda x: x[:2])
    return {i: (ref, round(s, 6)) for i, (s, _, ref) in best.items()}


def test_fuzzy_matches_are_those_of_all_pairs(spark, sf_dir):
    sides = fuzzy_sides(Tables(spark, sf_dir))
    parcels, refs = ([tuple(r) for r in side.collect()] for side in sides)
    got = {r.id: (r.ref, r.score) for r in matching.fuzzy_match(*sides).collect()}
    assert got == plain_matches(parcels, refs, 0.6) and len(got) > 20


@pytest.mark.parametrize("least", [0.4, 0.6, 0.85])
def test_odd_parcels(spark, least):
    rng = random.Random(least)
    word = lambda n: "".join(rng.choice("ab:1é語") for _ in range(rng.randint(0, n)))
    parcels = [(rng.choice([None, word(8), word(30)]), rng.choice([None, "1", "2"]), rng.choice([None, "1"]), rng.choice([None, "", "ab", word(5)])) for _ in range(60)] * 2
    refs = [(word(12), rng.choice([None, "1", "3"]), rng.choice([None, "1"]), rng.choice([None, "", "abc"]), i) for i in range(40)] + [(None, "1", "1", None, 40), ("x" * 300, None, None, None, 41), ("x" * 299 + "y", "9", "9", None, 42)]
    parcels += [("x" * 290 + "z", "7", "7", None)]
    a = spark.createDataFrame(parcels, "id string, number string, field string, district string")
    b = spark.createDataFrame(refs, "id string, number string, field string, district string, ord int")
    got = {r.id: (r.ref, r.score) for r in matching.fuzzy_match(a, b, least).collect()}
    assert got == plain_matches(parcels, refs, least)


@pytest.mark.parametrize("measure", ["jaccard", "dice"])
@pytest.mark.parametrize("threshold", [0.3, 0.75, 1.0])
def test_set_joins_lose_no_pair(spark, measure, threshold):
    rng = random.Random(threshold)
    sets = lambda n: [(i, [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 9))]) for i in range(n)] + [(n, None)]
    left, right = sets(60), sets(70)
    frame = lambda rows: spark.createDataFrame(rows, "id int, tokens array<string>")
    found = [tuple(r) for r in setjoin.join(frame(left), frame(right), measure=measure, threshold=threshold).collect()]
    want = {}
    for a, x in left:
        for b, y in right:
            if x and y:
                x_, y_ = set(x), set(y)
                s = len(x_ & y_) / len(x_ | y_) if measure == "jaccard" else 2 * len(x_ & y_) / (len(x_) + len(y_))
                if s >= threshold - 1e-9:
                    want[a, b] = s
    assert len(found) == len(want)
    assert all(abs(want[a, b] - s) < 1e-9 for a, b, s in found)


def test_trigram_index_gives_the_rows_of_the_scan(spark, sf_dir, tmp_path):
    rng = random.Random(4)
    words = ["müller", "mueller", "miller", "anna", "annabel", "schmidt", "schmid", "list", "last", "of", "streets"]
    names = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for i in range(400)] + [(400, None), (401, ""), (402, "Ünique name")]
    frame = spark.createDataFrame(names, "id int, name string")
    needles = spark.createDataFrame([(1, "anna schmid"), (2, "miller"), (3, "ünique"), (4, ""), (5, None), (6, "zzz")], "qid int, needle string")
    index = setjoin.TrigramIndex(spark, str(tmp_path / "i"), 0.4, buckets=16).build(frame, id_col="id", name_col="name")
    got = sorted((r.qid, r.id, round(r.similarity, 9)) for r in index.search(needles).collect())
    scan = needles.crossJoin(frame).withColumn("s", trigram_similarity(F.col("needle"), F.col("name"))).where("s >= 0.4 - 0.000000001")
    assert got == sorted((r.qid, r.id, round(r.s, 9)) for r in scan.collect()) and len(got) > 30
    assert index.candidates(needles).count() <= 1.5 * len(got) < 6 * 403 / 4
    assert index.search(needles, 0.9).count() < len(got)
    with pytest.raises(ValueError):
        index.search(needles, 0.1)


def meet(a, b):
    """Whether two polygons share a point: sides that touch, or one inside the other."""
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    sides = lambda r: list(zip(r, r[1:] + r[:1]))

    def cross(p, q, u, v):
        over = all(max(p[k], q[k]) >= min(u[k], v[k]) and max(u[k], v[k]) >= min(p[k], q[k]) for k in (0, 1))
        return over and turn(p, q, u) * turn(p, q, v) <= 0 and turn(u, v, p) * turn(u, v, q) <= 0

    def inside(ring, x):
        odd = False
        for p, q in sides(ring):
            if (p[1] > x[1]) != (q[1] > x[1]) and x[0] < (q[0] - p[0]) * (x[1] - p[1]) / (q[1] - p[1]) + p[0]:
                odd = not odd
        return odd

    return any(cross(*s, *t) for s in sides(a) for t in sides(b)) or inside(a, b[0]) or inside(b, a[0])


def test_polygons_of_many_sizes(spark):
    rng = random.Random(5)

    def polygon(size):
        lat, lng = rng.uniform(-2, 2), rng.uniform(-2, 2)
        return [[lat + size * rng.uniform(-1, 1), lng + size * rng.uniform(-1, 1)] for _ in range(3)]

    left = [(i, polygon(rng.choice([0.001, 0.02, 0.3]))) for i in range(150)] + [(900, None), (901, []), (902, [[0.0, 0.0], [1.0, 1.0]]), (903, [[float("nan"), 0.0]] * 3)]
    right = [(i, polygon(rng.choice([0.01, 0.2, 3.0]))) for i in range(60)] + [(60, [[-90.0, -180.0], [-90.0, 180.0], [90.0, 180.0], [90.0, -180.0]]), (61, None)]
    a, b = spark.createDataFrame(left, "id int, ring array<array<double>>"), spark.createDataFrame(right, "area_id int, area array<array<double>>")
    found = [tuple(r) for r in spatial.polygon_join(a, b, left_id="id", left_ring="ring", right_id="area_id", right_ring="area").collect()]
    want = {(i, j) for i, p in left[:150] for j, q in right[:61] if meet(p, q)}
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 300
    kept = sorted(r.id for r in spatial.in_areas(a, b.where("area_id < 20"), id_col="id", ring="ring").collect())
    assert kept == sorted({i for i, j in want if j < 20} | {900})


def test_ratios_are_worked_out_for_few_pairs(monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh:12é") for _ in range(rng.randint(1, n)))
    parcels = [{"id": f"{word(9)}:{i}", "number": rng.choice([None, "1", "2"]), "floor": rng.choice([0.3, 0.6, 0.9])} for i in range(150)]
    refs = [{"id": word(n), "number": rng.choice([None, "1", "3"]), "ord": i // 2} for i, n in enumerate([12] * 80 + [70, 90, 250])]
    refs += [{"id": parcels[5]["id"] * 30, "number": None, "ord": 90}, {"id": parcels[6]["id"][:-1], "number": "9", "ord": 91}]
    tried = []
    monkeypatch.setattr(matching.SequenceMatcher, "ratio", lambda self, of=SequenceMatcher.ratio: tried.append(1) or of(self))
    got = {x["id"]: (x["score"], x["o"], x["ref"]) for x in matching.best_ratios(parcels, refs)}
    asked, want = len(tried), {}
    for p in parcels:
        of = [(ratio(p["id"], r["id"]), -r["ord"], r["id"]) for r in refs if p["number"] is None or p["number"] != r["number"]]
        if max(of)[0] >= p["floor"]:
            want[p["id"]] = max(of)
    assert got == want and len(got) > 40
    assert asked < len(parcels) * len(refs) / 5
