"""Queries over geometry, parcels and reconciliation (2.3, 2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import geo as G
from corpusmill.operators import matching as X
from corpusmill.operators import spatial as SP
from corpusmill.plans.registry import phrase, query

# Customers stand for parcels: a place on a lattice, a number and a field follow from the key.
PLACE = "SELECT c_custkey AS id, c_nationkey AS park, 48.0 + (c_custkey % 40) * 0.05 AS lat, 9.0 + (c_custkey % 70) * 0.05 AS lng FROM customer"
BOXES = [("south", 48.0, 9.0, 49.0, 11.0), ("wide", 47.0, 9.0, 51.0, 12.0), ("rest", 40.0, 0.0, 60.0, 20.0)]


def places(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("park"), (F.lit(48.0) + (F.col("c_custkey") % 40) * F.lit(0.05)).alias("lat"), (F.lit(9.0) + (F.col("c_custkey") % 70) * F.lit(0.05)).alias("lng"))


def ring(lat, lng, half=0.01):
    return F.array(*[F.array(lat + a * half, lng + b * half) for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1))])


HAVERSINE = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(b_lat)) * pow(sin(radians(b_lng - lng) / 2), 2))))"


@query("g1_haversine", f"SELECT id, round({HAVERSINE}, 4) AS km FROM (SELECT *, 49.0 AS b_lat, 10.0 AS b_lng FROM ({PLACE}))")
def g1(t):
    return places(t).select("id", F.round(G.haversine_km(F.col("lat"), F.col("lng"), F.lit(49.0), F.lit(10.0)), 4).alias("km"))


@query(
    "g1_median_outliers",
    f"""WITH p AS (SELECT id, park, lat::DOUBLE AS lat, lng::DOUBLE AS lng FROM ({PLACE})), m AS (
  SELECT park, count(*) AS n, list_sort(list(lat))[count(*) // 2 + 1] AS b_lat, list_sort(list(lng))[count(*) // 2 + 1] AS b_lng FROM p GROUP BY 1
), d AS (SELECT p.*, n, {HAVERSINE} <= 60 AS close FROM p JOIN m USING (park))
SELECT id, park, lat, lng FROM (SELECT *, bool_or(close) OVER (PARTITION BY park) AS any_close FROM d) WHERE n <= 2 OR close OR NOT any_close""",
)
def g1b(t):
    return X.near_centre(places(t), "park", "lat", "lng", 60.0)


@query("g2_clearance", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN greatest(10.0 * (100 + c_custkey % 40 + 60), 500) WHEN c_custkey % 3 = 1 THEN 720.0 ELSE 1000.0 END AS metres FROM customer")
def g2(t):
    k = F.col("c_custkey")
    state = F.when(k % 3 == 0, "bayern").when(k % 3 == 1, "sachsen").otherwise("bremen")
    return t.customer.select(k.alias("id"), G.clearance_m(state, F.lit(100.0) + k % 40, F.lit(120.0), {"sachsen": 720.0}).alias("metres"))


@query("g2_circles_g6_centroids", f"SELECT id, 64::BIGINT AS n, round(lat::DOUBLE, 4) AS lat, round(lng::DOUBLE, 4) AS lng FROM ({PLACE})")
def g2b(t):
    made = places(t).select("id", G.circle(F.col("lat"), F.col("lng"), F.lit(2.0)).alias("ring"))
    return made.select("id", F.size("ring").cast("bigint").alias("n"), F.round(G.centroid(F.col("ring"))["lat"], 4).alias("lat"), F.round(G.centroid(F.col("ring"))["lng"], 4).alias("lng"))


@query("g3_g4_project_areas", f"SELECT id, CASE WHEN id % 4 = 0 THEN 'user_drawn' WHEN id % 4 = 1 THEN 'wea_convex_hull' WHEN id % 4 = 2 THEN 'center_buffer' ELSE 'none' END AS source, CASE WHEN id % 4 = 0 THEN round(round(0.02 * 111 * 0.03 * 111 * cos(radians(lat::DOUBLE + 0.01)), 4), 3) END AS drawn_km2 FROM ({PLACE})")
def g3(t):
    """Areas that were drawn, follow from turbines or from a centre; tests compare hulls and areas with plain versions."""
    # A hull is far more work than its row is large, so rows are dealt to all cores, however few files there are.
    p, k = places(t).repartition(4 * t.spark.sparkContext.defaultParallelism), F.col("id")
    lat, lng = F.col("lat"), F.col("lng")
    none = F.lit(None).cast("array<array<double>>")
    drawn = F.when(k % 4 == 0, F.array(F.array(lat, lng), F.array(lat, lng + 0.03), F.array(lat + 0.02, lng + 0.03), F.array(lat + 0.02, lng))).otherwise(none)
    turbines = F.when(k % 4 == 1, F.array(F.array(lat, lng), F.array(lat + 0.01, lng), F.array(lat, lng + 0.01), F.array(lat + 0.002, lng + 0.002), F.array(F.lit(0.0), F.lit(0.0)))).otherwise(none)
    area = G.project_area(drawn, turbines, F.when(k % 4 == 2, lat), lng)
    made = p.select("id", area.alias("a"))
    return made.select("id", "a.source", F.when(F.col("a.source") == "user_drawn", F.round(G.area_km2(F.col("a.ring")), 3)).alias("drawn_km2"))


@query("g5_grid_points", f"SELECT id, (count(*))::BIGINT AS n FROM (SELECT id, unnest(range(0, 4)) FROM ({PLACE})) GROUP BY 1")
def g5(t):
    box = places(t).select("id", F.explode(G.grid(F.col("lat"), F.col("lng"), F.col("lat") + 0.003, F.col("lng") + 0.003)).alias("p"))
    return box.groupBy("id").agg(F.count("*").alias("n"))


@query("g6_contains_point", f"SELECT id, lat > 48.99 AND lat < 49.51 AND lng > 9.99 AND lng < 10.51 AS inside FROM ({PLACE})")
def g6(t):
    box = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((48.99, 9.99), (48.99, 10.51), (49.51, 10.51), (49.51, 9.99))])
    return places(t).select("id", G.contains_point(box, F.col("lat"), F.col("lng")).alias("inside"))


@query("g6_polygons_meet", f"SELECT id, abs(lat::DOUBLE - 49.25) <= 0.203 AND abs(lng::DOUBLE - 10.25) <= 0.203 AS meet FROM ({PLACE})")
def g6_meet(t):
    """Squares of a tenth of a degree around places, against a diamond's box of three tenths."""
    box = lambda lat, lng, d: F.array(*[F.array(lat + a * d, lng + b * d) for a, b in ((-1, -1), (-1, 1), (1, 1), (1, -1))])
    return places(t).select("id", G.polygons_meet(box(F.col("lat"), F.col("lng"), 0.05), box(F.lit(49.25), F.lit(10.25), 0.153)).alias("meet"))


@query("g7_g8_maps", f"SELECT park AS project, count(*) FILTER (id % 3 <> 0) AS parcels, count(*) FILTER (id % 5 = 0) AS wea, 0::BIGINT AS project_area, 0::BIGINT AS clearance_zones, count(*) FILTER (id % 3 <> 0) + count(*) FILTER (id % 5 = 0) AS total FROM ({PLACE}) GROUP BY 1")
def g7(t):
    """Maps of parks with squares as parcels and points as turbines; some have no ring, some points lie at nothing."""
    p, k = places(t), F.col("id")
    none = F.lit(None).cast("array<array<double>>")
    text = lambda name, c: F.create_map(F.lit(name), c.cast("string"))
    parcels = p.select(F.col("park").alias("project"), F.lit("parcels").alias("layer"), k.alias("place"), F.when(k % 3 != 0, G.square(F.col("lat"), F.col("lng"), F.lit(10_000.0))).alias("ring"), "lat", "lng", text("id", k).alias("properties"))
    turbines = p.select(F.col("park").alias("project"), F.lit("wea").alias("layer"), k.alias("place"), none.alias("ring"), F.when(k % 5 == 0, F.col("lat")).otherwise(0.0).alias("lat"), F.when(k % 5 == 0, F.col("lng")).otherwise(0.0).alias("lng"), text("name", k).alias("properties"))
    made = G.geojson_collections(parcels.unionByName(turbines))
    total = F.get_json_object("geojson", "$.metadata.total_features").cast("bigint")
    return made.select("project", "parcels", "wea", "project_area", "clearance_zones", total.alias("total"))


def _first_state(boxes) -> str:
    return "CASE " + " ".join(f"WHEN lat BETWEEN {s} AND {n} AND lng BETWEEN {w} AND {e} THEN '{name}'" for name, (s, n, w, e) in boxes.items()) + " END"


@query("g9_states", f"SELECT id, {_first_state(G.LOOKUP_BOXES)} AS looked_up, {_first_state(G.CHECK_BOXES)} AS checked, CASE id % 4 WHEN 0 THEN lat BETWEEN 47.27 AND 55.06 AND lng BETWEEN 5.86 AND 15.04 WHEN 1 THEN lat BETWEEN 47.2701 AND 50.5647 AND lng BETWEEN 8.9764 AND 13.8396 WHEN 2 THEN true ELSE lat BETWEEN 49.3953 AND 51.6578 AND lng BETWEEN 7.7725 AND 10.2364 END AS allowed FROM (SELECT id, (lat + (id % 7) - 1)::DOUBLE AS lat, (lng - (id % 5))::DOUBLE AS lng FROM ({PLACE}))")
def g9(t):
    """States by either table of boxes, and whether a place may be in the one that is named."""
    k = F.col("id")
    p = places(t).select("id", (F.col("lat") + k % 7 - 1).alias("lat"), (F.col("lng") - k % 5).alias("lng"))
    named = F.when(k % 4 == 1, "bayern").when(k % 4 == 2, "atlantis").when(k % 4 == 3, "hessen")
    lat, lng = F.col("lat"), F.col("lng")
    return p.select("id", G.state_at(lat, lng).alias("looked_up"), G.state_at(lat, lng, G.CHECK_BOXES).alias("checked"), G.in_state(lat, lng, named).alias("allowed"))


@query("j12_parcel_contract_exact", "SELECT c.id, coalesce(f.contract, b.contract) AS contract, CASE WHEN f.contract IS NOT NULL THEN 'exact_full' WHEN b.contract IS NOT NULL THEN 'exact_number' END AS how FROM (SELECT c_custkey AS id, c_custkey % 60 AS number FROM customer) c LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS contract FROM orders GROUP BY 1) f ON c.id = f.o_custkey LEFT JOIN (SELECT o_orderkey % 90 AS number, max(o_orderkey) AS contract FROM orders GROUP BY 1) b ON c.number = b.number")
def j12(t):
    parcels = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 60).alias("number"))
    contracts = t.orders.select(F.col("o_custkey").alias("ref"), (F.col("o_orderkey") % 90).alias("ref_number"), F.col("o_orderkey").alias("contract"), F.col("o_orderkey").alias("ord"))
    return X.exact_match(parcels, contracts).select("id", "contract", "how")


@query("j13_parcel_contract_fuzzy")
def j13(t):
    """Customers as parcels, suppliers as contracts' references; tests/test_matching.py compares all pairs."""
    return X.fuzzy_match(*fuzzy_sides(t))


def fuzzy_sides(t):
    number, field = (F.col("c_custkey") % 40).cast("string"), (F.col("c_custkey") % 3).cast("string")
    made = t.customer.select(F.concat_ws(":", F.lower("c_mktsegment"), field, number, F.col("c_custkey").cast("string")).alias("id"), number.alias("number"), field.alias("field"), F.lower("c_mktsegment").alias("district"))
    k = F.col("s_suppkey")
    names = phrase(("machinery", "building", "furniture", "x"), k)
    refs = t.supplier.select(
        F.concat_ws(":", names, (k % 4).cast("string"), (k % 50).cast("string")).alias("id"), (k % 50).cast("string").alias("number"), (k % 4).cast("string").alias("field"), F.when(k % 3 != 0, names).alias("district"), k.alias("ord")
    )
    return made, refs


@query("j14_spatial_filter", f"SELECT id FROM ({PLACE}) WHERE id % 5 = 0 OR (lat - 0.01 <= 49.5 AND lat + 0.01 >= 49.0 AND lng - 0.01 <= 10.5 AND lng + 0.01 >= 10.0)")
def j14(t):
    area = t.spark.range(1).select(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((49.0, 10.0), (49.0, 10.5), (49.5, 10.5), (49.5, 10.0))]).alias("area"))
    made = places(t).withColumn("ring", F.when(F.col("id") % 5 != 0, ring(F.col("lat"), F.col("lng"))))
    return SP.in_areas(made, area.withColumn("area_id", F.lit(1)), id_col="id", ring="ring").select("id")


AREAS = "SELECT s_suppkey AS area_id, 48.0 + (s_suppkey % 37) * 0.06 AS lat, 9.0 + (s_suppkey % 53) * 0.07 AS lng, CASE WHEN s_suppkey % 4 = 0 THEN 0.6 ELSE 0.003 * (s_suppkey % 9 + 1) END AS half FROM supplier"


@query(
    "j14_polygon_join",
    f"""SELECT id, area_id FROM (SELECT id, lat::DOUBLE AS lat, lng::DOUBLE AS lng FROM ({PLACE}) WHERE id % 5 <> 0), (SELECT area_id, lat::DOUBLE AS a, lng::DOUBLE AS b, half::DOUBLE AS half FROM ({AREAS}))
WHERE greatest(abs(lat - a) - 0.0101, 0) + greatest(abs(lng - b) - 0.0101, 0) <= half""",
)
def j14_many(t):
    """Every pair of a parcel (a square) and an area (a square on its corner, of one of many sizes) that share a point."""
    k = F.col("s_suppkey")
    half = F.when(k % 4 == 0, F.lit(0.6)).otherwise(F.lit(0.003) * (k % 9 + 1))
    lat, lng = F.lit(48.0) + (k % 37) * F.lit(0.06), F.lit(9.0) + (k % 53) * F.lit(0.07)
    corners = F.array(*[F.array(lat + a * half, lng + b * half) for a, b in ((-1, 0), (0, 1), (1, 0), (0, -1))])
    made = places(t).where("id % 5 <> 0").withColumn("ring", ring(F.col("lat"), F.col("lng"), 0.0101))
    return SP.polygon_join(made, t.supplier.select(k.alias("area_id"), corners.alias("area")), left_id="id", left_ring="ring", right_id="area_id", right_ring="area")


@query("j16_point_in_box", f"SELECT id, CASE WHEN lat BETWEEN 48 AND 49 AND lng BETWEEN 9 AND 11 THEN 'south' WHEN lat BETWEEN 47 AND 51 AND lng BETWEEN 9 AND 12 THEN 'wide' ELSE 'rest' END AS box FROM ({PLACE})")
def j16(t):
    p = places(t)
    return p.select("id", X.first_box(p, BOXES, "lat", "lng").alias("box"))


@query("w11_f40_reconciliation", "SELECT l_partkey AS field, any_value(w) AS winner, count(*) - 1 AS rejected, count(*) FILTER (abs(l_quantity - w) > 0 AND abs(l_quantity - w) / greatest(abs(w), 1) > 0.02) AS diverging FROM (SELECT *, first_value(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_returnflag, l_discount DESC, l_orderkey * 10 + l_linenumber) AS w FROM lineitem) GROUP BY 1")
def w11(t):
    c = t.lineitem.select(F.col("l_partkey").alias("field"), "l_quantity", "l_returnflag", "l_discount", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return X.reconcile(c, "field", "l_quantity", "l_returnflag", "l_discount", "ord")
