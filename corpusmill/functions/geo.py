"""Geometry on latitude and longitude, as column expressions."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance (G1)."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), F.lit(2))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def circle(lat: Column, lng: Column, radius_km: Column, points: int = 64) -> Column:
    """A ring of [lat, lng] around a centre."""
    def at(i: Column) -> Column:
        angle = F.lit(2.0) * F.pi() * i / F.lit(points)
        return F.array(lat + radius_km / F.lit(KM_PER_DEGREE) * F.cos(angle), lng + radius_km / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat))) * F.sin(angle))

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def clearance_m(state: Column, hub: Column, rotor: Column, table: dict[str, float] | None = None) -> Column:
    """Ten times the height in Bavaria and Hesse, at least 500; else by table, else 1000."""
    out = F.when(state.isin("bayern", "hessen"), F.greatest(F.lit(10.0) * (hub + rotor / 2), F.lit(500.0)))
    for name, metres in (table or {}).items():
        out = out.when(state == name, F.lit(float(metres)))
    return out.otherwise(F.lit(1000.0))


def bbox(ring: Column) -> Column:
    """(south, west, north, east) of a ring."""
    lats, lngs = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.struct(F.array_min(lats).alias("south"), F.array_min(lngs).alias("west"), F.array_max(lats).alias("north"), F.array_max(lngs).alias("east"))


def boxes_meet(a: Column, b: Column) -> Column:
    return (a["south"] <= b["north"]) & (b["south"] <= a["north"]) & (a["west"] <= b["east"]) & (b["west"] <= a["east"])


def centroid(ring: Column) -> Column:
    """Mean of the corners."""
    n = F.size(ring)
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / n
    return F.struct(mean(0).alias("lat"), mean(1).alias("lng"))


def ring_area(ring: Column) -> Column:
    """Area in square degrees by the shoelace formula."""
    nxt = F.concat(F.slice(ring, 2, 1 << 30), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, nxt, lambda p, q: p[0] * q[1] - q[0] * p[1]), F.lit(0.0), lambda s, x: s + x)) / 2


def contains_point(ring: Column, lat: Column, lng: Column) -> Column:
    """Ray casting."""
    nxt = F.concat(F.slice(ring, 2, 1 << 30), F.slice(ring, 1, 1))
    crosses = F.zip_with(ring, nxt, lambda p, q: ((p[0] > lat) != (q[0] > lat)) & (lng < (q[1] - p[1]) * (lat - p[0]) / F.when(q[0] != p[0], q[0] - p[0]) + p[1]))
    return F.size(F.filter(crosses, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def square(lat: Column, lng: Column, area_m2: Column, km_per_lng: float = 67.0) -> Column:
    """A closed square of an area around a point."""
    half = F.sqrt(area_m2) / 2000
    dy, dx = half / F.lit(KM_PER_DEGREE), half / F.lit(km_per_lng)
    corner = lambda a, b: F.array(lat + a * dy, lng + b * dx)
    return F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1), corner(-1, -1))


def grid(south: Column, west: Column, north: Column, east: Column, metres: float = 300.0, most: int = 400) -> Column:
    """Lattice points of a box, coarsened to at most so many."""
    step = F.lit(metres / 1000 / KM_PER_DEGREE)
    rows, cols = F.floor((north - south) / step) + 1, F.floor((east - west) / step) + 1
    scale = F.greatest(F.lit(1.0), F.sqrt(rows * cols / F.lit(float(most))))
    wide = step * F.ceil(scale)
    span = lambda a, b: F.sequence(F.lit(0), F.floor((b - a) / wide).cast("int"))
    return F.flatten(F.transform(span(south, north), lambda i: F.transform(span(west, east), lambda j: F.array(F.round(south + i * wide, 4), F.round(west + j * wide, 4)))))


def geojson_feature(ring: Column, properties: Column) -> Column:
    """A polygon feature, longitude first, ring closed."""
    closed = F.when(ring[0] == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    swapped = F.transform(closed, lambda p: F.array(p[1], p[0]))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(swapped).alias("coordinates")).alias("geometry"), properties.alias("properties")))


def _hull(points: list) -> list:
    """Monotone chain, from the least point on, against the clock on a map; lines are not kept as corners."""
    pts = sorted({(p[0], p[1]) for p in points if p is not None and None not in (p[0], p[1])})
    if len(pts) < 3:
        return [list(p) for p in pts]

    def half(order):
        out = []
        for p in order:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return [list(p) for p in half(pts) + half(pts[::-1])]


@F.arrow_udf(ArrayType(ArrayType(DoubleType())))
def convex_hull(points: pa.Array) -> pa.Array:
    """Corners of the convex hull of [lat, lng] points (G3). Stacks of points have no built-in; a list holds a project's few."""
    return pa.array([None if ps is None else _hull(ps) for ps in points.to_pylist()], pa.list_(pa.list_(pa.float64())))


def buffered_hull(points: Column, degrees: float = 0.005, steps: int = 64) -> Column:
    """The hull with a rim of so many degrees, its corners rounded by as many-sided circles (G3); under three points their box with the rim."""
    turns = [2 * math.pi * i / steps for i in range(steps)]
    rims = [(degrees * math.cos(a), degrees * math.sin(a)) for a in turns]

    @F.arrow_udf(ArrayType(ArrayType(DoubleType())))
    def rimmed(points: pa.Array) -> pa.Array:
        made = lambda ps: _hull([(p[0] + x, p[1] + y) for p in ps if p is not None and None not in p for x, y in rims])
        return pa.array([None if ps is None or len(ps) < 3 else made(ps) for ps in points.to_pylist()], pa.list_(pa.list_(pa.float64())))

    box = bbox(points)
    s, w, n, e = box["south"] - degrees, box["west"] - degrees, box["north"] + degrees, box["east"] + degrees
    rim = F.array(F.array(n, w), F.array(n, e), F.array(s, e), F.array(s, w))
    return F.when(F.size(points) >= 3, rimmed(points)).when(F.size(points) > 0, rim)


def area_km2(ring: Column) -> Column:
    """Square kilometres at the latitude of the centre of the area, to four places; 0 under three corners."""
    nxt = F.concat(F.slice(ring, 2, 1 << 30), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, nxt, lambda p, q: F.struct((p[1] * q[0] - q[1] * p[0]).alias("c"), (p[0] + q[0]).alias("y")))
    add = lambda name: F.aggregate(terms, F.lit(0.0), lambda s, t: s + (t["c"] if name == "c" else t["c"] * t["y"]))
    twice = add("c")
    lat = F.when(twice != 0, add("cy") / (3 * twice)).otherwise(centroid(ring)["lat"])
    return F.when(F.size(ring) >= 3, F.round(F.abs(twice) / 2 * KM_PER_DEGREE * KM_PER_DEGREE * F.cos(F.radians(lat)), 4)).otherwise(0.0)


def polygons_meet(a: Column, b: Column) -> Column:
    """Whether two rings share a point: a corner of one lies in the other, or sides cross (G6). False without three corners each."""
    sides = lambda r: F.arrays_zip(r.alias("p"), F.concat(F.slice(r, 2, 1 << 30), F.slice(r, 1, 1)).alias("q"))
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def crosses(s: Column, t: Column) -> Column:
        p, q, u, v = s["p"], s["q"], t["p"], t["q"]
        over = lambda k: (F.greatest(p[k], q[k]) >= F.least(u[k], v[k])) & (F.greatest(u[k], v[k]) >= F.least(p[k], q[k]))
        return over(0) & over(1) & (turn(p, q, u) * turn(p, q, v) <= 0) & (turn(u, v, p) * turn(u, v, q) <= 0)

    cross = F.exists(sides(a), lambda s: F.exists(sides(b), lambda t: crosses(s, t)))
    inside = contains_point(a, b[0][0], b[0][1]) | contains_point(b, a[0][0], a[0][1])
    return F.coalesce((F.size(a) >= 3) & (F.size(b) >= 3) & boxes_meet(bbox(a), bbox(b)) & (inside | cross), F.lit(False))


def project_area(drawn: Column, turbines: Column, lat: Column, lng: Column) -> Column:
    """(ring, source): the area drawn, else the rimmed hull of the turbines, else a circle of two kilometres, else none."""
    known = F.filter(turbines, lambda p: (p[0] != 0) & (p[1] != 0))
    none = F.lit(None).cast("array<array<double>>")
    made = lambda ring, source: F.struct(ring.alias("ring"), F.lit(source).alias("source"))
    return (
        F.when(F.size(drawn) >= 3, made(drawn, "user_drawn"))
        .when(F.size(known) > 0, made(buffered_hull(known), "wea_convex_hull"))
        .when(lat.isNotNull() & lng.isNotNull(), made(circle(lat, lng, F.lit(2.0), 32), "center_buffer"))
        .otherwise(made(none, "none"))
    )


#: Layers of a map.
LAYERS = ("parcels", "project_area", "wea", "clearance_zones")


def geojson_collections(features: DataFrame, project: str = "project") -> DataFrame:
    """features (project, layer, place, ring, lat, lng, properties map) -> (project, geojson, one count a layer).

    Polygons without a ring and points at 0, 0 are left out; rings are closed and longitude comes first. One row
    of a project has its whole map, as the format asks for.
    """
    ring = F.col("ring")
    polygon = geojson_feature(ring, F.map_concat(F.create_map(F.lit("layer"), F.col("layer")), "properties"))
    point = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates")).alias("geometry"), F.map_concat(F.create_map(F.lit("layer"), F.col("layer")), "properties").alias("properties")))
    written = F.when(F.col("layer") == "wea", F.when((F.col("lat") != 0) | (F.col("lng") != 0), point)).otherwise(F.when(F.size(ring) > 0, polygon))
    order = F.coalesce(*[F.when(F.col("layer") == name, F.lit(k)) for k, name in enumerate(LAYERS)])
    each = features.select(F.col(project), "layer", order.alias("o"), "place", written.alias("f")).where("f is not null")
    counts = [F.count_if(F.col("layer") == name).alias(name) for name in LAYERS]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o", "place", "f"))), lambda x: x["f"])
    whole = each.groupBy(project).agg(listed.alias("fs"), *counts)
    head = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("fs", ","), F.lit('],"metadata":'))
    metadata = F.to_json(F.struct(F.lit("EPSG:4326").alias("crs"), F.size("fs").alias("total_features"), F.struct(*LAYERS).alias("layers")))
    return whole.select(project, F.concat(head, metadata, F.lit("}")).alias("geojson"), *LAYERS)


#: Boxes of the states (south, north, west, east), once as places are looked up and once as findings are checked.
LOOKUP_BOXES = {
    "niedersachsen": (51.2951, 54.1378, 6.3459, 11.5981),
    "nordrhein-westfalen": (50.3227, 52.5315, 5.8663, 9.4617),
    "schleswig-holstein": (53.3598, 55.0992, 7.5212, 11.6724),
    "brandenburg": (51.3591, 53.5591, 11.2658, 14.7658),
    "mecklenburg-vorpommern": (53.1104, 54.8850, 10.5939, 14.4122),
    "sachsen-anhalt": (50.9379, 53.0418, 10.5608, 13.1868),
    "bayern": (47.2701, 50.5647, 8.9764, 13.8396),
    "hessen": (49.3953, 51.6578, 7.7725, 10.2364),
    "thüringen": (50.2043, 51.6493, 9.8770, 12.6539),
    "sachsen": (50.1713, 51.6851, 11.8723, 15.0419),
    "rheinland-pfalz": (48.9664, 50.9423, 6.1123, 8.5083),
    "baden-württemberg": (47.5325, 49.7913, 7.5117, 10.4956),
    "saarland": (49.1120, 49.6394, 6.3558, 7.4048),
    "bremen": (53.0112, 53.5984, 8.4816, 8.9908),
    "hamburg": (53.3951, 54.0277, 8.1045, 10.3253),
    "berlin": (52.3382, 52.6755, 13.0883, 13.7612),
}
CHECK_BOXES = {
    "baden-württemberg": (47.53, 49.79, 7.51, 10.50),
    "bayern": (47.27, 50.56, 8.98, 13.84),
    "berlin": (52.34, 52.68, 13.09, 13.76),
    "brandenburg": (51.36, 53.56, 11.27, 14.77),
    "bremen": (53.01, 53.61, 8.48, 8.99),
    "hamburg": (53.39, 53.74, 8.42, 10.33),
    "hessen": (49.39, 51.66, 7.77, 10.24),
    "mecklenburg-vorpommern": (53.11, 54.69, 10.59, 14.41),
    "niedersachsen": (51.30, 53.89, 6.65, 11.60),
    "nordrhein-westfalen": (50.32, 52.53, 5.86, 9.46),
    "rheinland-pfalz": (48.97, 50.94, 6.11, 8.51),
    "saarland": (49.11, 49.64, 6.36, 7.40),
    "sachsen": (50.17, 51.69, 11.87, 15.04),
    "sachsen-anhalt": (50.94, 53.04, 10.56, 13.19),
    "schleswig-holstein": (53.36, 55.06, 7.86, 11.31),
    "thüringen": (50.20, 51.65, 9.87, 12.65),
}
#: A box around all of them.
COUNTRY = (47.27, 55.06, 5.86, 15.04)


def _in(box: tuple[float, float, float, float], lat: Column, lng: Column) -> Column:
    return lat.between(box[0], box[1]) & lng.between(box[2], box[3])


def in_state(lat: Column, lng: Column, state: Column, boxes: dict[str, tuple[float, float, float, float]] | None = None) -> Column:
    """Whether a point may be in a state; a state that is not known refuses none, and one that is not given none in the country."""
    known = boxes or LOOKUP_BOXES
    named = F.coalesce(*[F.when(state == name, _in(box, lat, lng)) for name, box in known.items()], F.lit(True))
    return F.when(state.isNull(), _in(COUNTRY, lat, lng)).otherwise(named)


def state_at(lat: Column, lng: Column, boxes: dict[str, tuple[float, float, float, float]] | None = None) -> Column:
    """The first state whose box holds a point, in the order of the table."""
    return F.coalesce(*[F.when(_in(box, lat, lng), F.lit(name)) for name, box in (boxes or LOOKUP_BOXES).items()])
