"""Spatial joins: polygons are dealt to cells, meet by an equi-join on cells, and are then compared exactly.

The cells are a quadtree's: a polygon lies in the cells of the level whose width is at least its
own extent, so in four at most, whatever its size. Polygons of different levels meet at the coarser
level, for which the finer one names the cells above its own. A pair that shares several cells counts
in the one that holds the lower left corner of what their boxes have in common, so nothing is made twice.

Equal rings are dealt and compared once; their ids come in only when the pairs of rings are known, in packs: a task
writes each id of one pack beside all of the other, so rows take little room in columns and are dealt evenly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import geo as G
from corpusmill.session import checkpointed

#: Width of the finest cells in degrees, and the number of levels; the coarsest are wider than the earth.
FINEST, LEVELS = 0.01, 17
#: Ids in a pack and pairs that a task writes, about; ids in a row beside one of the other side.
PACK, WRITTEN, RUN = 1024, 20_000_000, 256


def _cell(x: Column, level: Column) -> Column:
    return F.floor(x / (F.lit(FINEST) * F.pow(F.lit(2.0), level))).cast("bigint")


def _dealt(rows: DataFrame, ring: str, levels: list[int]) -> DataFrame:
    """A row for each cell, of the own level and of the given coarser ones. Rows without three corners, or with one that isn't finite, have none."""
    sound = (F.size(ring) >= 3) & F.forall(ring, lambda p: p[0].isNotNull() & p[1].isNotNull() & (F.abs(p[0]) <= 1000) & (F.abs(p[1]) <= 1000))
    boxed = rows.where(sound).withColumn("__box", G.bbox(F.col(ring)))
    extent = F.greatest(F.col("__box.north") - F.col("__box.south"), F.col("__box.east") - F.col("__box.west"))
    own = F.least(F.greatest(F.ceil(F.log2(F.greatest(extent / FINEST, F.lit(1.0)))), F.lit(0)), F.lit(LEVELS)).cast("int")
    leveled = boxed.withColumn("__own", own).withColumn("__level", F.explode(F.array_distinct(F.concat(F.array("__own"), F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x > F.col("__own"))))))
    across = leveled.withColumn("__x", F.explode(F.sequence(_cell(F.col("__box.south"), F.col("__level")), _cell(F.col("__box.north"), F.col("__level")))))
    return across.withColumn("__y", F.explode(F.sequence(_cell(F.col("__box.west"), F.col("__level")), _cell(F.col("__box.east"), F.col("__level")))))


def _levels(rows: DataFrame, ring: str) -> list[int]:
    """The levels that there are: a few numbers."""
    return sorted(r[0] for r in _dealt(rows, ring, []).select("__own").distinct().collect())


def _shapes(rows: DataFrame, id_col: str, ring: str, side: str) -> tuple[DataFrame, DataFrame]:
    """(members, shapes): each row's id with the number of its ring, and each distinct ring once with how many have it. Numbers are kept, so they hold."""
    named = rows.select(F.col(id_col).alias(side), F.col(ring).alias(f"ring_{side}")).where(F.col(f"ring_{side}").isNotNull())
    shapes = checkpointed(named.groupBy(f"ring_{side}").agg(F.count("*").alias(f"n_{side}")).withColumn(f"shape_{side}", F.monotonically_increasing_id()))
    return checkpointed(named.join(shapes, f"ring_{side}").select(side, f"shape_{side}", f"n_{side}", F.monotonically_increasing_id().alias("__place"))), shapes


def _packed(rows: DataFrame, by: str, item: str, n: str) -> DataFrame:
    """(by, items): the rows of one ``by``, n of them, in packs of about ``PACK``, dealt by their places. Structs keep ids that are null."""
    part = F.pmod(F.xxhash64("__place"), F.ceil(F.col(n) / PACK))
    return rows.groupBy(by, part.alias("__part")).agg(F.collect_list(F.struct(item)).alias(f"{item}s")).drop("__part")


def _runs(ids: Column) -> Column:
    """Cut into runs of ``RUN`` ids, then one of a multiple of eight, then the rest: Parquet packs eight values at a time, so only such runs are written alike again."""
    even = F.size(ids) - F.size(ids) % 8
    starts = F.filter(F.sequence(F.lit(1), F.greatest(even, F.lit(1)), F.lit(RUN)), lambda i: i <= even)
    runs = F.transform(starts, lambda i: F.slice(ids, i, F.least(F.lit(RUN), even - i + 1)))
    return F.when(even < F.size(ids), F.concat(runs, F.array(F.slice(ids, even + 1, F.lit(8))))).otherwise(runs)


def _pairs(shared: DataFrame, few: str, many: str, members: dict[str, DataFrame], rows: float) -> DataFrame:
    """(a, b) of pairs of rings, of which the side ``few`` has fewer ids: only these are written out for each ring before they are packed."""
    by = f"shape_{many}"
    each = shared.groupBy(by).agg(F.sum(f"n_{few}").alias("__n"))
    met = shared.select(by, f"shape_{few}").join(each, by).join(members[few].drop(f"n_{few}"), f"shape_{few}")
    packs = _packed(members[many], by, many, f"n_{many}").join(_packed(met, by, few, "__n"), by)
    dealt = packs.select(f"{few}s", f"{many}s").repartition(max(1, math.ceil(rows / WRITTEN)))
    runs = dealt.select(f"{few}s", F.explode(_runs(F.col(f"{many}s"))).alias(f"{many}s"))
    return runs.select(F.inline(f"{few}s"), f"{many}s").select(few, F.inline(f"{many}s")).select("a", "b")


def polygon_join(left: DataFrame, right: DataFrame, *, left_id: str, left_ring: str, right_id: str, right_ring: str) -> DataFrame:
    """(left_id, right_id) of all pairs of polygons that share a point (J14, G6). Rings are arrays of [lat, lng]."""
    (members_a, a), (members_b, b) = _shapes(left, left_id, left_ring, "a"), _shapes(right, right_id, right_ring, "b")
    dealt_a, dealt_b = _dealt(a, "ring_a", _levels(b, "ring_b")), _dealt(b, "ring_b", _levels(a, "ring_a"))
    dealt_b = dealt_b.withColumnsRenamed({"__box": "__box2", "__own": "__own2"})
    met = dealt_a.join(dealt_b, ["__level", "__x", "__y"]).where(F.col("__level") == F.greatest("__own", "__own2"))
    corner = (F.col("__x") == _cell(F.greatest("__box.south", "__box2.south"), F.col("__level"))) & (F.col("__y") == _cell(F.greatest("__box.west", "__box2.west"), F.col("__level")))
    meet = met.where(corner & G.boxes_meet(F.col("__box"), F.col("__box2"))).where(G.polygons_meet(F.col("ring_a"), F.col("ring_b")))
    fewer = F.col("n_b") <= F.col("n_a")
    shared = checkpointed(meet.select("shape_a", "n_a", "shape_b", "n_b"))
    rows = {r[0]: r[1] for r in shared.groupBy(fewer).agg(F.sum(F.col("n_a").cast("double") * F.col("n_b"))).collect()} or {True: 0.0}
    members = {"a": members_a, "b": members_b}
    parts = [_pairs(shared.where(fewer if few == "b" else ~fewer), few, many, members, rows[few == "b"]) for few, many in (("b", "a"), ("a", "b")) if (few == "b") in rows]
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return every.select(F.col("a").alias(left_id), F.col("b").alias(right_id))


def in_areas(parcels: DataFrame, areas: DataFrame, *, id_col: str, ring: str, area_id: str = "area_id", area: str = "area") -> DataFrame:
    """Parcels that meet any of the areas; those without geometry stay."""
    met = polygon_join(parcels, areas, left_id=id_col, left_ring=ring, right_id=area_id, right_ring=area).select(F.col(id_col).alias("__met")).distinct()
    return parcels.where(F.col(ring).isNull()).unionByName(parcels.where(F.col(ring).isNotNull()).join(met, F.col(id_col) == F.col("__met"), "left_semi"))
