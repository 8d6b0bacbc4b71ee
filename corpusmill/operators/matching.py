"""Matching parcels to contracts, classification by place, and reconciliation of candidates."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructType

from corpusmill.functions import geo as G
from corpusmill.operators.ranking import placed
from corpusmill.session import checkpointed


def exact_match(parcels: DataFrame, contracts: DataFrame) -> DataFrame:
    """parcels (id, number), contracts (ref, ref_number, contract, ord): by full id (1.0), else by bare number (0.85); the last contract of a key wins."""
    full = contracts.where("ref is not null").groupBy("ref").agg(F.max_by("contract", "ord").alias("full_contract"))
    bare = contracts.where("ref_number is not null").groupBy("ref_number").agg(F.max_by("contract", "ord").alias("bare_contract"))
    joined = parcels.join(full, F.col("id") == F.col("ref"), "left").join(bare, F.col("number") == F.col("ref_number"), "left")
    how = F.when(F.col("full_contract").isNotNull(), "exact_full").when(F.col("bare_contract").isNotNull(), "exact_number")
    return joined.select(*parcels.columns, F.coalesce("full_contract", "bare_contract").alias("contract"), how.alias("how"), F.when(how == "exact_full", 1.0).when(how == "exact_number", 0.85).alias("confidence"))


@F.arrow_udf(DoubleType())
def similarity_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """The ratio of matching blocks, which no built-in gives."""
    return pa.array([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def fuzzy_score(p: dict[str, Column], r: dict[str, Column]) -> Column:
    """1 if equal; .9 for number and field with a district missing, else .7 and a share of the districts' likeness; .5 for the number; else likeness of the ids."""
    same_number, same_field = p["number"] == r["number"], p["field"] == r["field"]
    missing = F.coalesce(p["district"], F.lit("")).eqNullSafe(F.lit("")) | F.coalesce(r["district"], F.lit("")).eqNullSafe(F.lit(""))
    near = 0.7 + 0.3 * similarity_ratio(F.coalesce(p["district"], F.lit("")), F.coalesce(r["district"], F.lit("")))
    return F.when(p["id"] == r["id"], 1.0).when(same_number & same_field & missing, 0.9).when(same_number & same_field, near).when(same_number, 0.5).otherwise(similarity_ratio(p["id"], r["id"]))


#: Parcels and references that are compared at once: what a task holds is bounded by their product.
PARCELS, REFERENCES = 1024, 512


def _common(a: list[str], b: list[str]) -> np.ndarray:
    """For each pair an upper bound of the characters in matching blocks: those that both have, or, where b has up to 63, the longest common subsequence."""
    held = [Counter(x) for x in b]
    most = np.zeros((len(a), len(b)), np.int64)
    counts = [Counter(x) for x in a]
    for c in {c for h in held for c in h}:
        mine = np.array([x[c] for x in counts])
        if mine.any():
            most += np.minimum.outer(mine, np.array([h[c] for h in held]))
    short = np.array([j for j, x in enumerate(b) if len(x) < 64], np.int64)
    if not len(short):
        return most
    # Bits of a word stand for the characters of b; a bit that is cleared is one more character in common.
    codes = {c: i for i, c in enumerate(sorted({c for j in short for c in b[j]}))}
    marks = np.zeros((len(codes) + 1, len(short)), np.uint64)
    for k, j in enumerate(short):
        for at, c in enumerate(b[j]):
            marks[codes[c], k] |= np.uint64(1 << at)
    open_ = np.full((len(a), len(short)), np.uint64(2**64 - 1))
    order = sorted(range(len(a)), key=lambda i: -len(a[i]))
    lengths = [len(a[i]) for i in order]
    for at in range(lengths[0] if lengths else 0):
        rows = np.array(order[: sum(n > at for n in lengths)])
        old = open_[rows]
        met = old & marks[[codes.get(a[i][at], len(codes)) for i in rows]]
        open_[rows] = (old + met) | (old - met)
    masks = np.array([(1 << len(b[j])) - 1 for j in short], np.uint64)
    most[:, short] = np.minimum(most[:, short], np.bitwise_count(~open_ & masks))
    return most


def best_ratios(parcels: list[dict], refs: list[dict]) -> list[dict]:
    """The reference of the greatest ratio, and the earliest of equals, for each parcel (id, number, floor) whose floor one reaches; refs (id, number, ord).

    Pairs are tried from the greatest upper bound down, until it falls under the best ratio found. References of the parcel's own number take no part.
    """
    a, b = [p["id"] for p in parcels], [r["id"] for r in refs]
    sums = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
    bounds = 2.0 * _common(a, b) / np.maximum(sums, 1)
    numbers = {n: i for i, n in enumerate({r["number"] for r in refs} - {None})}
    own, theirs = (np.array([numbers.get(x["number"], none) for x in side]) for side, none in ((parcels, -1), (refs, -2)))
    bounds[own[:, None] == theirs[None, :]] = -1.0
    floors = np.array([p["floor"] for p in parcels])
    ords = np.array([r["ord"] for r in refs])
    matchers: dict[int, SequenceMatcher] = {}
    found = []
    for i in np.flatnonzero((bounds >= floors[:, None]).any(axis=1)).tolist():
        some = np.flatnonzero(bounds[i] >= floors[i])
        best = None
        for j in some[np.lexsort((ords[some], -bounds[i, some]))].tolist():
            if best and (bounds[i, j], -refs[j]["ord"]) < best[:2]:
                break
            if j not in matchers:
                matchers[j] = SequenceMatcher(None, "", b[j])
            matchers[j].set_seq1(a[i])
            ratio = matchers[j].ratio()
            if ratio >= floors[i] and (best is None or (ratio, -refs[j]["ord"], b[j]) > best):
                best = (ratio, -refs[j]["ord"], b[j])
        if best:
            found.append({"id": a[i], "score": best[0], "o": best[1], "ref": best[2]})
    return found


_FOUND = ArrayType(StructType().add("id", "string").add("score", "double").add("o", "long").add("ref", "string"))


@F.arrow_udf(_FOUND)
def _best_ratios(parcels: pa.Array, refs: pa.Array) -> pa.Array:
    return pa.array([best_ratios(p.as_py(), r.as_py()) for p, r in zip(parcels, refs)], to_arrow_type(_FOUND))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(rows): all columns' rows in arrays of about ``size``, dealt by a hash."""
    parts = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts))).repartition(min(parts, 4 * rows.sparkSession.sparkContext.defaultParallelism), "part")
    return dealt.groupBy("part").agg(F.collect_list(F.struct(*rows.columns)).alias("rows")).select("rows")


def fuzzy_match(parcels: DataFrame, refs: DataFrame, least: float = 0.6) -> DataFrame:
    """The best reference of each parcel, the earliest of equals.

    Equal ids, and equal numbers (and fields, where the number alone isn't enough), are equi-joins. What they
    give a parcel is the least that the likeness of ids has to reach; for it, packs of parcels meet packs of distinct
    references, and bounds decide which pairs get the exact ratio.
    """
    if not 0 < least <= 1:
        raise ValueError("least: over 0, at most 1")
    p = checkpointed(parcels.select("id", "number", "field", "district").where("id is not null").distinct())
    r = checkpointed(refs.groupBy("id", "number", "field", "district").agg(F.min("ord").alias("ord")).select(*(F.col(c).alias(f"r_{c}") for c in ("id", "number", "field", "district", "ord"))))
    same = p.join(r, F.col("id") == F.col("r_id"))
    keys = (F.col("number") == F.col("r_number")) if least <= 0.5 else (F.col("number") == F.col("r_number")) & (F.col("field") == F.col("r_field"))
    numbered = p.join(r, keys)
    score = fuzzy_score({c: F.col(c) for c in ("id", "number", "field", "district")}, {c: F.col(f"r_{c}") for c in ("id", "number", "field", "district")})
    order = lambda s, o, ref: F.max(F.struct(F.col(s).alias("score"), o.alias("o"), F.col(ref).alias("ref"))).alias("b")
    joined = checkpointed(same.unionByName(numbered).withColumn("score", score).where(F.col("score") >= least).groupBy("id").agg(order("score", (-F.col("r_ord")).cast("bigint"), "r_id")))
    asked = p.select("id", "number").distinct().join(joined, "id", "left").select("id", "number", F.coalesce("b.score", F.lit(float(least))).alias("floor")).where("id != '' and floor < 1")
    given = r.where("r_id is not null and r_id != ''").groupBy(F.col("r_id").alias("id"), F.col("r_number").alias("number")).agg(F.min("r_ord").cast("bigint").alias("ord"))
    packs = _packed(checkpointed(asked), PARCELS).withColumnRenamed("rows", "parcels").crossJoin(_packed(checkpointed(given), REFERENCES).withColumnRenamed("rows", "refs"))
    near = packs.select(F.inline(_best_ratios("parcels", "refs"))).groupBy("id").agg(order("score", F.col("o"), "ref"))
    best = joined.unionByName(near).groupBy("id").agg(F.max("b").alias("b"))
    return best.select("id", F.col("b.ref").alias("ref"), F.round("b.score", 6).alias("score"))


def near_mentions(docs: DataFrame, id_col: str, text_col: str, left: str, right: str, *, most: int) -> DataFrame:
    """(id, left_at, right_at): hits of two patterns in one text under ``most`` characters apart.

    Positions are binned by the distance, and a hit meets those of its own and the two neighbouring bins only,
    so a text with many hits is split by place and no pair far apart is made.
    """

    def hits(pattern: str, name: str) -> DataFrame:
        # The text before each hit, cut at the hits: their lengths add up to the positions.
        parts, marks = F.split(text_col, pattern), F.regexp_extract_all(text_col, F.lit(f"({pattern})"), F.lit(1))
        sizes = F.zip_with(F.slice(parts, 1, F.size(marks)), marks, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda acc, x: F.struct((acc["at"] + x["p"] + x["m"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["p"])).alias("out"))
        return docs.where(F.col(text_col).rlike(pattern)).select(F.col(id_col).alias("id"), F.explode(F.aggregate(sizes, start, add, lambda acc: acc["out"])).alias(name))

    a = hits(left, "left_at").withColumn("bin", F.explode(F.array(*[F.expr(f"left_at div {most}") + i for i in (-1, 0, 1)])))
    b = hits(right, "right_at").withColumn("bin", F.expr(f"right_at div {most}"))
    met = a.join(b, ["id", "bin"]).where(F.abs(F.col("left_at") - F.col("right_at")) < most)
    return met.select(F.col("id").alias(id_col), F.col("left_at").cast("bigint"), F.col("right_at").cast("bigint"))


def first_box(points: DataFrame, boxes: list[tuple[str, float, float, float, float]], lat: str, lng: str) -> Column:
    """The first box (name, south, west, north, east) that holds a point."""
    return F.coalesce(*[F.when(F.col(lat).between(s, n) & F.col(lng).between(w, e), F.lit(name)) for name, s, w, n, e in boxes])


def near_centre(points: DataFrame, group: str, lat: str, lng: str, most_km: float = 25.0) -> DataFrame:
    """Points within a distance of their group's upper median; groups of two or fewer, or that would vanish, stay whole (G1).

    Medians come from places in sorted ranges and the rest are sums, so no task sorts a group. Without a group rows take no part.
    """
    points = points.where(F.col(group).isNotNull())
    sizes = checkpointed(points.groupBy(group).agg(F.count("*").alias("__n")))

    def upper(c: str) -> DataFrame:
        ranked = placed(points.select(group, c), [group], [F.col(c)]).join(sizes, group)
        return ranked.where("place = __n div 2 + 1").select(group, F.col(c).alias(f"__{c}"))

    centres = checkpointed(sizes.join(upper(lat), group).join(upper(lng), group))
    near = G.haversine_km(F.col(lat), F.col(lng), F.col(f"__{lat}"), F.col(f"__{lng}")) <= most_km
    close = points.join(centres, group).withColumn("__close", near)
    some = close.groupBy(group).agg(F.max("__close").alias("__any"))
    return close.join(some, group).where("__n <= 2 or __close or not __any").select(*points.columns)


def reconcile(candidates: DataFrame, field: str, value: str, precedence: str, confidence: str, order: str) -> DataFrame:
    """Winner of each field and how many candidates diverge from it by over two percent (W11, F40). Two aggregations, no list of candidates."""
    best = candidates.groupBy(field).agg(F.min(F.struct(F.col(precedence).alias("p"), (-F.col(confidence)).alias("c"), F.col(order).alias("o"), F.col(value).alias("v"))).alias("w"))
    joined = candidates.join(best, field)
    d = F.abs(F.col(value) - F.col("w.v"))
    return joined.groupBy(field).agg(F.first("w.v").alias("winner"), (F.count("*") - 1).alias("rejected"), F.count_if((d > 0) & (d / F.greatest(F.abs(F.col("w.v")), F.lit(1.0)) > 0.02)).alias("diverging"))
