import math
import random

import pytest
from pyspark.sql import functions as F

from flightloom.operators import containment, exposure, polygons, proximity

from .conftest import rows

VERTEX = "image string, poly int, vertice int, x double, y double"
SQUARE = [("i", 0, k, float(x), float(y)) for k, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]


def test_square(spark):
    edges = polygons.ring_edges(spark.createDataFrame(SQUARE, VERTEX))
    assert rows(edges.drop("image", "poly")) == [
        (0, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 1.0, 1.0), (2, 1.0, 1.0, 0.0, 1.0), (3, 0.0, 1.0, 0.0, 0.0)
    ]
    got = polygons.area_and_centroid(edges).first()
    assert (got["n_vertices"], got["area"], got["centroid_x"], got["centroid_y"]) == (4, 1.0, 0.5, 0.5)


def test_flat_ring_and_too_few_vertices(spark):
    flat = [("i", 0, k, float(k), float(k)) for k in range(3)]
    pair = [("i", 1, 0, 0.0, 0.0), ("i", 1, 1, 5.0, 5.0)]
    got = polygons.area_and_centroid(polygons.ring_edges(spark.createDataFrame(flat + pair, VERTEX))).collect()
    assert [(r["poly"], r["area"], r["centroid_x"], r["centroid_y"]) for r in got] == [(0, 0.0, 1.0, 1.0)]


def test_large_ring_keeps_all_edges(spark):
    ring = [("i", 0, k, math.cos(k / 500 * math.tau), math.sin(k / 500 * math.tau)) for k in range(500)]
    edges = polygons.ring_edges(spark.createDataFrame(ring, VERTEX), rows_per_task=50)
    got = polygons.area_and_centroid(edges).first()
    assert got["n_vertices"] == 500
    assert got["area"] == pytest.approx(250 * math.sin(math.tau / 500))


def test_renumber(spark):
    gaps = [(i, p, k * 4 + 7, x, y) for i, p, k, x, y in SQUARE]
    for limit in (None, 2):
        fixed = polygons.renumber(spark.createDataFrame(gaps, VERTEX), rows_per_task=limit)
        assert rows(fixed) == rows(spark.createDataFrame(SQUARE, VERTEX))


def test_unpack(spark):
    docs = spark.createDataFrame([("a.jpg", "[[[[1,2]],[[3,4]],[[5,6]]],[[[7,8]]]]"), ("b.jpg", "{oops")], "data string, json string")
    got = polygons.unpack_polygons(docs, "data", "json")
    assert rows(got) == [
        ("a.jpg", 0, 0, 1, 2, 3), ("a.jpg", 0, 1, 3, 4, 3), ("a.jpg", 0, 2, 5, 6, 3), ("a.jpg", 1, 0, 7, 8, 1)
    ]
    assert rows(polygons.unpack_log(docs, "data", "json"), "image", "ok") == [("a.jpg", 1), ("b.jpg", 0)]


def test_sizes_and_ranks(spark):
    areas = spark.createDataFrame([("i", 0, 100.0), ("i", 1, 300.0), ("i", 2, 200.0), ("j", 0, 1.0)], "image string, poly int, area double")
    assert rows(polygons.keep_large(areas), "poly") == [(1,), (2,)]
    for limit in (None, 1):
        got = polygons.by_size(areas, limit)
        assert rows(got, "image", "poly", "size_rank") == [("i", 0, 2), ("i", 1, 0), ("i", 2, 1), ("j", 0, 0)]


def _km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def _storm_data(spark, seed):
    rng = random.Random(seed)
    points = [(f"f{i % 40}", i, rng.choice([0, 1]), rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(300)]
    points += [("poles", 1000 + i, 0, lat, lon) for i, (lat, lon) in enumerate([(90.0, 0.0), (-90.0, 50.0), (89.5, -179.9), (0.0, 180.0), (0.0, -180.0)])]
    points += [("copies", 2000, 1, 10.0, 20.0)] * 30
    reach = [0.0, 5.0, 80.0, 250.0, 1000.0, 4000.0, 12000.0, 25000.0]
    storms = [(rng.choice([0, 1]), rng.uniform(-90, 90), rng.uniform(-180, 180), rng.choice(reach)) for _ in range(60)]
    storms += [(0, 89.9, 10.0, 300.0), (0, 0.0, 179.9, 60.0), (1, 10.0, 20.0, 0.0)]
    p = spark.createDataFrame(points, "flightid string, dt_radar long, h int, lat double, lon double")
    s = spark.createDataFrame(storms, "h int, lat double, lon double, radius_km double")
    hour = F.timestamp_seconds(F.col("h") * 3600).alias("hour_ts")
    return points, storms, p.select("flightid", "dt_radar", "lat", "lon", hour), s.select("lat", "lon", "radius_km", hour)


@pytest.mark.parametrize("seed,limit", [(1, None), (2, 20), (3, 5)])
def test_exposure_equals_brute_force(spark, seed, limit):
    points, storms, p, s = _storm_data(spark, seed)
    near = [(f, t, sum(1 for h2, a, b, r in storms if h2 == h and _km((lat, lon), (a, b)) <= r)) for f, t, h, lat, lon in points]
    flags = {(f, t): int(n > 0) for f, t, n in near}
    got = exposure.point_exposure(p, s, limit)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == flags
    totals = {}
    for f, _, n in near:
        totals[f] = totals.get(f, 0) + n
    flights = exposure.flight_exposure(p, s, limit)
    assert {r["flightid"]: r["flight_through_area"] for r in flights.collect()} == totals


def test_exposure_without_storms(spark):
    _, _, p, s = _storm_data(spark, 4)
    got = exposure.point_exposure(p, s.limit(0))
    assert got.agg(F.max("flight_through_area")).first()[0] == 0


def _inside(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.mark.parametrize("seed,limit,size", [(1, None, 10.0), (2, 15, 3.0), (3, 4, 25.0)])
def test_containment_equals_brute_force(spark, seed, limit, size):
    rng = random.Random(seed)
    rings = {(b, p): [(rng.uniform(-40, 40), rng.uniform(-40, 40)) for _ in range(rng.randint(2, 9))] for b in (0, 1) for p in range(4)}
    rings[(0, 9)] = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    points = [(f"f{i % 7}", i, rng.uniform(-45, 45), rng.uniform(-45, 45), rng.choice([0, 1])) for i in range(200)]
    points += [("f0", 500, 5.0, 5.0, 0)] * 20
    vertices = [(b, p, k, x, y) for (b, p), ring in rings.items() for k, (x, y) in enumerate(ring)]
    pdf = spark.createDataFrame(points, "flightid string, dt_radar long, lon double, lat double, bucket int")
    vdf = spark.createDataFrame(vertices, "bucket int, poly int, vertice int, x double, y double")
    want, hits = {}, {key: 0 for key, ring in rings.items() if len(ring) >= 3}
    for f, t, x, y, b in points:
        held = [key for key, ring in rings.items() if key[0] == b and len(ring) >= 3 and _inside(x, y, ring)]
        want[(f, t)] = int(bool(held))
        for key in held:
            hits[key] += 1
    marked = containment.mark_inside(pdf, vdf, size=size, rows_per_task=limit)
    assert {(r["flightid"], r["dt_radar"]): r["inside"] for r in marked.collect()} == want
    assert marked.agg(F.sum("copies")).first()[0] == len(points)
    found = containment.polygons_hit(pdf, vdf, size=size, rows_per_task=limit)
    assert {(r["bucket"], r["poly"]): r["points"] for r in found.collect()} == hits


def test_crossings_are_not_rows(spark):
    """Points are shuffled once, by square, and meet the polygons there: nothing is grouped by point and polygon."""
    ring = [(0, p, k, x + p / 9, y) for p in range(5) for k, (x, y) in enumerate([(0.0, 0.0), (9.0, 1.0), (8.0, 9.0), (1.0, 8.0)])]
    vertices = spark.createDataFrame(ring, "bucket int, poly int, vertice int, x double, y double")
    data = [("f", i, float(i % 10), float(i % 7), 0) for i in range(70)] + [("g", 1, None, 1.0, 0), ("g", 1, None, 1.0, 0), ("g", 2, 1.0, 1.0, None)]
    points = spark.createDataFrame(data, "flightid string, dt_radar long, lon double, lat double, bucket int")
    marked = containment.mark_inside(points, vertices)
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Aggregate [_cx" in plan and "poly" not in plan[: plan.index("FlatMapCoGroupsInArrow")]
    assert rows(marked.where("flightid = 'g'"), "dt_radar", "copies", "inside") == [(1, 2, 0), (2, 1, 0)]
    edges = polygons.ring_edges(vertices, ["bucket", "poly"])
    found = containment.containments(points, edges, ["poly"], 2.5)
    sums = found.groupBy("bucket", "poly").agg(F.sum("copies").alias("points"))
    assert found.columns == ["flightid", "dt_radar", "lon", "lat", "bucket", "copies", "poly"]
    summed = containment.containments(points, edges, ["poly"], 2.5, per_point=False).groupBy("bucket", "poly").agg(F.sum("points"))
    assert rows(sums) == rows(summed) and len(rows(sums)) == 5


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("grid", [True, False])
def test_small_squares_equal_brute_force(closed, grid, monkeypatch):
    """Also with rings that lack edges and points on vertices; most points are settled without a comparison."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    lon, lat = rng.uniform(0, 2.5, (2, 3000))
    rings, odd = [rng.normal(0, s, (n, 2)) + rng.uniform(0, 2.5, 2) for s in (0.1, 1.0, 9.0) for n in (3, 5, 12)], np.arange(9) % 3 == 0
    if grid:
        lon, lat, rings = np.round(lon * 8) / 8, np.round(lat * 8) / 8, [np.round(v * 4) / 4 for v in rings]
    edges = [np.column_stack([v, np.roll(v, -1, 0)]) for v in rings]
    edges = [e[(e[:, 1] != e[:, 3]) & (closed | (rng.random(len(e)) < 0.6))] for e in edges]
    kind = pa.list_(pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")]))
    listed = [[dict(zip(("x1", "y1", "x2", "y2"), map(float, r))) for r in e] for e in edges]
    polygons_ = pa.table({"edges": pa.chunked_array([pa.array(listed, kind)]), "odd": odd})
    want = np.repeat(odd[:, None], 3000, axis=1)
    for q, e in enumerate(edges):
        for x1, y1, x2, y2 in e:
            want[q] ^= ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
    compared, real = [], containment._compared
    monkeypatch.setattr(containment, "_compared", lambda places, at, *rest: compared.append(places.counts[at % places.g**2].sum()) or real(places, at, *rest))
    monkeypatch.setattr(containment, "_PAIRS", 500)
    places, of = containment._dealt(pa.table({"lon": np.append(lon, np.nan), "lat": np.append(lat, 1.0)}))
    got = np.zeros((9, 3001), bool)
    for first, whole, polys, found in containment._held(places, polygons_):
        for q, cell in zip(*np.nonzero(whole)):
            got[first + q, of[places.starts[cell] : places.starts[cell] + places.counts[cell]]] = True
        got[first + polys, of[found]] = True
    assert (got[:, :3000] == want).all() and not got[:, 3000].any()
    assert sum(compared) < sum(map(len, edges)) * 3000 / (1 if grid or not closed else 3)


def test_points_are_shuffled_by_square_only(spark):
    ring = [(0, 0, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (9.0, 1.0), (8.0, 9.0)])]
    vertices = spark.createDataFrame(ring, "bucket int, poly int, vertice int, x double, y double")
    points = spark.createDataFrame([("f", 1, 1.0, 1.0, 0)], "flightid string, dt_radar long, lon double, lat double, bucket int")
    marked = containment.mark_inside(points, vertices)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    of_points = plan[plan.index("FlatMapCoGroupsInArrow") :].split("\n")
    of_points = of_points[: next(i for i, line in enumerate(of_points) if i and "Scan" in line) + 1]
    assert sum("Exchange" in line for line in of_points) == 1


def test_most_exposed_falls_back_to_densest(spark):
    marked = spark.createDataFrame([("a", 0, 1), ("b", 0, 1), ("b", 0, 2)], "flightid string, inside int, copies long")
    assert containment.most_exposed(marked).first()["flightid"] == "b"
    marked = spark.createDataFrame([("a", 1, 1), ("b", 0, 1), ("b", 0, 2)], "flightid string, inside int, copies long")
    assert containment.most_exposed(marked).first()["flightid"] == "a"


def _components(polys, reach):
    parent = {p: p for p in polys}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    keys = list(polys)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if any(math.dist(p, q) <= reach for p in polys[a] for q in polys[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in polys}


def test_near_and_far_polygons(spark):
    data = [("i", 0, 0, 0.0, 0.0), ("i", 1, 0, 19.0, 0.0), ("i", 2, 0, 40.0, 0.0), ("j", 0, 0, 0.0, 0.0), ("j", 1, 0, 0.0, 20.0)]
    got = proximity.proximity_components(spark.createDataFrame(data, VERTEX))
    assert rows(got) == [("i", 0, 0), ("i", 1, 0), ("i", 2, 2), ("j", 0, 0), ("j", 1, 0)]


@pytest.mark.parametrize("seed,limit,span", [(1, None, 400), (2, 10, 250), (3, 3, 600)])
def test_components_and_hulls_equal_brute_force(spark, seed, limit, span):
    rng = random.Random(seed)
    polys = {p: [(rng.randrange(-span, span), rng.randrange(-span, span)) for _ in range(3)] for p in range(40)}
    polys[40] = [(k * 15, -span - 100) for k in range(30)]
    polys[41] = [(3, -span - 100)] * 50
    data = [("i", p, k, float(x), float(y)) for p, pts in polys.items() for k, (x, y) in enumerate(pts)]
    vertices = spark.createDataFrame(data, VERTEX)
    want = _components(polys, 20)
    components = proximity.proximity_components(vertices, rows_per_task=limit)
    assert {r["poly"]: r["component"] for r in components.collect()} == want
    hulls = {}
    for r in proximity.proximity_hulls(vertices, components, limit).orderBy("vertice").collect():
        hulls.setdefault(r["component"], []).append((r["x"], r["y"]))
    for c in set(want.values()):
        members = {pt for p, pts in polys.items() if want[p] == c for pt in pts}
        ring = hulls[c]
        assert set(ring) <= members
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for x, y in members)


def test_long_chain_is_one_component(spark):
    data = [("i", k, 0, 15.0 * k, 0.0) for k in range(200)]
    got = proximity.proximity_components(spark.createDataFrame(data, VERTEX))
    assert {r["component"] for r in got.collect()} == {0}


def test_storm_centre_beyond_the_pole(spark):
    hour = F.timestamp_seconds(F.lit(0)).alias("hour_ts")
    p = spark.createDataFrame([("a", 1, 80.0, -150.0), ("b", 2, 80.0, 30.0)], "flightid string, dt_radar long, lat double, lon double")
    s = spark.createDataFrame([(100.0, 30.0, 50.0)], "lat double, lon double, radius_km double")
    got = exposure.point_exposure(p.select("*", hour), s.select("*", hour))
    assert rows(got, "flightid", "flight_through_area") == [("a", 1), ("b", 0)]


def test_rim_candidates_are_few(spark):
    """At a radius of thousands of kilometres, rows compared with a storm are at most three times the hits among them."""
    rng = random.Random(8)
    hour = F.timestamp_seconds(F.lit(0)).alias("hour_ts")
    points = [(f"f{i}", i, rng.uniform(-60, 60), rng.uniform(-180, 180)) for i in range(3000)]
    storms = [(rng.uniform(-50, 50), rng.uniform(-180, 180), rng.choice([900.0, 2500.0, 7000.0, 30000.0])) for _ in range(12)]
    p = spark.createDataFrame(points, "flightid string, dt_radar long, lat double, lon double").select("*", hour)
    s = spark.createDataFrame(storms, "lat double, lon double, radius_km double").select("*", hour)
    placed = exposure._cells(p)
    pairs = placed.join(exposure.storms_of_cells(placed.select("hour_ts", "_row", "_col").distinct(), s), ["hour_ts", "_row", "_col"])
    compared = pairs.where("radius_km IS NOT NULL").collect()
    hits = sum(_km((r.lat, r.lon), (r.s_lat, r.s_lon)) <= r.radius_km for r in compared)
    every = sum(_km((a, b), (c, d)) <= r for _, _, a, b in points for c, d, r in storms)
    assert sum(r["n"] for r in exposure.storm_hits(p, s).collect()) == every
    assert hits < every / 4 and len(compared) <= 3 * hits


def test_covered_squares_settle_their_points(spark, monkeypatch):
    """Where one storm covers a square, no other storm of the hour is laid out or compared there."""
    hour = F.timestamp_seconds(F.lit(0)).alias("hour_ts")
    storms = [(0.0, 0.0, 19000.0)] + [(a * 3.0 + 1.0, b * 7.0, 400.0) for a in range(-20, 20) for b in range(-20, 20)]
    s = spark.createDataFrame(storms, "lat double, lon double, radius_km double").select("*", hour)
    points = [(i, i, -80.0 + i % 160, -170.0 + i * 7 % 340) for i in range(300)] + [(900, 900, 0.5, 179.5)]
    p = spark.createDataFrame([tuple(map(float, r)) for r in points], "flightid double, dt_radar double, lat double, lon double").select("*", hour)
    near = []
    join = exposure.skew_join
    monkeypatch.setattr(exposure, "skew_join", lambda left, right, *a, **k: near.append((left, right)) or join(left, right, *a, **k))
    got = exposure.point_exposure(p, s)
    want = {float(f): int(any(_km((lat, lon), (c, d)) <= r for c, d, r in storms)) for f, _, lat, lon in points}
    assert {r["flightid"]: r["flight_through_area"] for r in got.collect()} == want
    left, right = near[0]
    assert left.count() < 10 and right.count() < 5000


@pytest.mark.parametrize("tile", [1, 3])
def test_components_across_tiles(spark, monkeypatch, tile):
    rng = random.Random(tile)
    data = [(f"i{k % 2}", k, rng.randrange(-300, 300), rng.randrange(0, 300), v) for k in range(60) for v in range(2)]
    table = spark.createDataFrame(data, "image string, poly int, x int, y int, vertice int")
    whole = rows(proximity.proximity_components(table))
    monkeypatch.setattr(proximity, "TILE", tile)
    assert rows(proximity.proximity_components(table)) == whole and len({r[2] for r in whole}) < 60


@pytest.mark.parametrize("pairs,spans", [(1_000_000, 200_000), (300, 7)])
def test_storms_at_points_equal_brute_force(pairs, spans, monkeypatch):
    """Also on whole degrees, at the poles and the date line, with storms of no size and of the size of the globe."""
    import numpy as np

    monkeypatch.setattr(exposure, "_PAIRS", pairs)
    monkeypatch.setattr(exposure, "_SPANS", spans)
    rng = np.random.default_rng(2)
    lat, lon = np.round(rng.uniform(-90, 90, 400)), np.round(rng.uniform(-180, 180, 400))
    lat[:10], lat[10:20], lon[20:30], lon[30:40] = 90, -90, 180, -180
    s_lat, s_lon = np.round(rng.uniform(-120, 120, 150)), np.round(rng.uniform(-400, 400, 150))
    s_lat[:20], s_lon[:20] = lat[10:30], lon[10:30]
    radius = rng.choice([0.0, 5.0, 250.0, 1000.0, 4000.0, 12000.0, 20010.0, 25000.0], 150)
    want = [sum(_km(p, s) <= r for s, r in zip(zip(s_lat, s_lon), radius)) for p in zip(lat, lon)]
    assert exposure.storms_at(lat, lon, s_lat, s_lon, radius).tolist() == want


def test_flight_exposure_meets_storms_by_hour_only(spark):
    """Storms are not rows per square, and points are shuffled once."""
    points, storms, p, s = _storm_data(spark, 6)
    p = p.unionByName(p.limit(3).withColumns({"flightid": F.lit("nowhere"), "lat": F.lit(None).cast("double")}))
    p = p.unionByName(p.limit(2).withColumns({"flightid": F.lit("never"), "hour_ts": F.lit(None).cast("timestamp")}))
    found = exposure.flight_exposure(p, s)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "_row" not in plan and "Generate" not in plan
    got = {r["flightid"]: r["flight_through_area"] for r in found.collect()}
    assert got["nowhere"] == got["never"] == 0 and found.where("flightid = 'never'").first()["first_storm_hour"] is None
    many = [(0, 10.0, 20.0, 100.0)] * 50 + [(0, 10.0, 20.5, 100.0 + i) for i in range(50)]
    crowd = spark.createDataFrame(many, "h int, lat double, lon double, radius_km double").withColumn("hour_ts", F.timestamp_seconds("h"))
    one = spark.createDataFrame([(f"f{i % 3}", i, 10.0, 20.0) for i in range(60)], "flightid string, dt_radar long, lat double, lon double")
    one = one.withColumn("hour_ts", F.timestamp_seconds(F.lit(0)))
    assert rows(exposure.flight_exposure(one, crowd, 7), "flightid", "flight_through_area") == [(f"f{i}", 2000) for i in range(3)]
