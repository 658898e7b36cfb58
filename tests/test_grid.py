"""Grid maps and movement against brute force on small tables."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featherline.functions.geo import haversine_km, solar_zenith
from featherline.operators import grid, trellis

NOON = dt.datetime(2024, 3, 20, 12)


def test_distance_and_sun(spark):
    df = spark.createDataFrame([(NOON,)], "t timestamp")
    r = df.select(
        haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("quarter"),
        solar_zenith(F.col("t"), F.lit(0.0), F.lit(0.0)).alias("equinox"),
        solar_zenith(F.lit("2024-06-20 12:00:00").cast("timestamp"), F.lit(23.44), F.lit(0.0)).alias("solstice"),
    ).first()
    assert r.quarter == pytest.approx(math.pi / 2 * 6371)
    assert r.equinox < 2.5 and r.solstice < 1.0


def test_twilight_of_a_path_has_the_sun_at_the_horizon(spark):
    path = spark.createDataFrame(
        [("a", dt.date(2024, 5, 1), 55.7, 13.4), ("b", dt.date(2024, 6, 21), 80.0, 0.0)],
        "id string, date date, lat double, lon double",
    )
    out = grid.path_twilight(path)
    up = solar_zenith(F.col("sunrise").cast("timestamp"), F.col("lat"), F.col("lon"))
    down = solar_zenith(F.col("sunset").cast("timestamp"), F.col("lat"), F.col("lon"))
    a, b = out.select("id", "sunrise", up.alias("up"), down.alias("down")).orderBy("id").collect()
    assert a.up == pytest.approx(90.833, abs=0.3) and a.down == pytest.approx(90.833, abs=0.3)
    assert b.sunrise is None


def test_stationary_periods(spark):
    flags = [False, False, True, True, False, True, False, False]
    df = spark.createDataFrame(
        [("a", NOON + dt.timedelta(hours=i), f) for i, f in enumerate(flags)],
        "id string, date timestamp, is_flight boolean",
    )
    for limit in (None, 2):
        got = grid.staps(df, 1, max_rows=limit).orderBy("stap_id").collect()
        assert [(r.stap_id, r.n, r.duration_hours, r.include) for r in got] == [
            (1, 2, 1.0, True),
            (2, 1, 0.0, False),
            (3, 2, 1.0, True),
        ]


def test_grid_of_the_default_extent(spark):
    df = spark.createDataFrame(
        [("a", 5.0, 60.0, -27.0, 57.0, 2)],
        "id string, west double, east double, south double, north double, scale int",
    )
    cells = grid.grid(df)
    assert cells.count() == 18480
    r = cells.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    assert tuple(r) == (-26.75, 56.75, 5.25, 59.75)


def test_pressure_map_ignores_a_constant_offset(spark):
    hours = [NOON + dt.timedelta(hours=i) for i in range(30)]
    wave = [math.sin(i / 3) * 3 for i in range(30)]
    tag = spark.createDataFrame(
        [("a", 1, h, 990 + w) for h, w in zip(hours, wave)],
        "id string, stap_id int, date timestamp, pressure_hpa double",
    )
    cells = [(50.0, h, 995 + w) for h, w in zip(hours, wave)]
    cells += [(51.0, h, 990 - w) for h, w in zip(hours, wave)]
    cells += [(52.0, h, 950 + w) for h, w in zip(hours, wave)]
    era = spark.createDataFrame(cells, "lat double, ts timestamp, surface_pressure double").withColumn(
        "lon", F.lit(10.0)
    )
    got = {r.lat: r for r in grid.pressure_map(tag, era).collect()}
    assert got[50.0].mse == pytest.approx(0, abs=1e-9) and got[50.0].likelihood == pytest.approx(1)
    assert got[51.0].likelihood == pytest.approx(
        math.exp(-math.log(30) * np.var([2 * w for w in wave]) / (2 * 0.8**2))
    )
    assert got[52.0].likelihood == 0.0


def test_pressure_map_is_the_same_for_any_blocks_and_parts(spark):
    hours = [NOON + dt.timedelta(hours=i) for i in range(12)]
    rng = np.random.default_rng(3)
    tags = [(f"t{k}", 1 + i % 2, h, 990 + float(rng.normal())) for k in range(9) for i, h in enumerate(hours)]
    tag = spark.createDataFrame(tags, "id string, stap_id int, date timestamp, pressure_hpa double")
    places = [(lat, lon) for lat in (-89.5, -10.0, 0.0, 30.0, 70.0) for lon in (-179.5, -170.0, 0.0, 20.0, 179.5)]
    cells = [(lat, lon, h, 985 + float(rng.normal())) for lat, lon in places for h in hours]
    era = spark.createDataFrame(cells, "lat double, lon double, ts timestamp, surface_pressure double")
    extents = spark.createDataFrame(
        [("t0", -5, 25, -10, 30), ("t1", 170, -175, -90, 90), ("t2", 50, 60, 0, 10), ("t3", 20, 20, 30, 30), ("t9", 0, 1, 0, 1)],
        "id string, west int, east int, south int, north int",
    )
    inside = {
        "t0": lambda lat, lon: -5 <= lon <= 25 and -10 <= lat <= 30,
        "t1": lambda lat, lon: lon >= 170 or lon <= -175,
        "t2": lambda lat, lon: False,
        "t3": lambda lat, lon: (lat, lon) == (30, 20),
    }
    pressures, surface = {}, {}
    for name, stap, h, p in tags:
        pressures.setdefault((name, stap), {})[h] = p
    for lat, lon, h, p in cells:
        surface.setdefault((lat, lon), {})[h] = p
    for limits in (None, extents):
        want = {}
        for (name, stap), series_ in pressures.items():
            for place, era_ in surface.items():
                if limits is None or inside.get(name, lambda *_: True)(*place):
                    d = [p - era_[h] for h, p in series_.items()]
                    want[(name, stap, *place)] = (len(d), np.var(d))
        for block, rows_per_key in ((10.0, 1000), (7.0, 2), (500.0, 1)):
            got = grid.pressure_map(tag, era, extents=limits, block=block, rows_per_key=rows_per_key).collect()
            assert {(r.id, r.stap_id, r.lat, r.lon): (r.n, pytest.approx(r.mse)) for r in got} == want
            assert len(got) == len(want)
    assert grid.pressure_map(tag.limit(0), era).count() == 0 and grid.pressure_map(tag, era.limit(0)).count() == 0


def test_pressure_mask_allows_for_the_ground_of_a_cell(spark):
    tag = spark.createDataFrame(
        [("a", 1, NOON + dt.timedelta(hours=i), 900.0 + i % 2) for i in range(10)],
        "id string, stap_id int, date timestamp, pressure_hpa double",
    )
    era = tag.select(F.col("date").alias("ts")).withColumns(
        {
            "lat": F.lit(50.0),
            "lon": F.lit(10.0),
            "surface_pressure": F.lit(1000.0),
            "altitude": F.lit(100.0),
            "temperature_2m": F.lit(288.0),
        }
    )
    assert grid.pressure_map(tag, era).first().share_in_range == 0.0
    hilly = era.withColumns({"altitude_min": F.lit(0.0), "altitude_max": F.lit(1100.0)})
    assert grid.pressure_map(tag, hilly).first().share_in_range == 1.0


def test_twilights_follow_the_day_offset(spark):
    light = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, d, h), float(lux)) for d, h, lux in [(1, 6, 5), (1, 18, 5), (2, 1, 5), (2, 7, 0), (2, 9, 9)]],
        "id string, ts timestamp, lux double",
    )
    got = {(r.day.day, r.series): r.timestamp for r in grid.twilights(light, 3, 0).collect()}
    assert got == {
        (1, "Rise"): dt.datetime(2024, 1, 1, 6),
        (1, "Set"): dt.datetime(2024, 1, 2, 1),
        (2, "Rise"): dt.datetime(2024, 1, 2, 9),
        (2, "Set"): dt.datetime(2024, 1, 2, 9),
    }


def test_light_map_prefers_the_true_place(spark):
    place = (20.0, 15.0)
    path = spark.createDataFrame(
        [("a", dt.date(2024, 11, 1) + dt.timedelta(days=i), *place) for i in range(20)],
        "id string, date date, lat double, lon double",
    )
    times = grid.path_twilight(path).select("id", "lat", "lon", F.explode(F.array("sunrise", "sunset")).alias("timestamp"))
    calib = grid.calibration(times, 0.5)
    cells = spark.createDataFrame(
        [("a", float(lat), float(lon)) for lat in (0, 10, 20, 30) for lon in (5, 15, 25)],
        "id string, lat double, lon double",
    )
    rows = times.select("id", F.lit(1).alias("stap_id"), "timestamp")
    best = grid.map_to_path(grid.light_map(rows, cells, calib)).first()
    assert (best.lat, best.lon) == place


def nodes_and_links(spark, seed=1, tags=("a", "b")):
    rng = random.Random(seed)
    cells, flights = [], []
    for tag in tags:
        last = 4 if tag == "a" else 3
        for stap in range(1, last + 1):
            for lat, lon in itertools.product((0.0, 2.0, 4.0), (0.0, 3.0)):
                cells.append((tag, stap, lat, lon, rng.random()))
            flights.append((tag, stap, rng.choice([2.0, 3.0, 5.0])))
    return (
        cells,
        flights,
        spark.createDataFrame(cells, "id string, stap_id int, lat double, lon double, likelihood double"),
        spark.createDataFrame(flights, "id string, stap_id int, flight_hours double"),
    )


def km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


def brute_force(cells, flights, tag):
    """All paths of one tag with their weight."""
    hours = {s: h for t, s, h in flights if t == tag}
    stages = {}
    for t, s, lat, lon, p in cells:
        if t == tag:
            stages.setdefault(s, []).append((lat, lon, p))
    paths = {}
    for path in itertools.product(*[stages[s] for s in sorted(stages)]):
        weight = math.prod(p for _, _, p in path)
        for s, (a, b) in enumerate(zip(path, path[1:]), start=1):
            distance = km(a[:2], b[:2])
            if distance > hours[s] * 150:
                weight = 0
                break
            v = max(distance / hours[s], 20)
            weight *= v**5 * math.exp(-v / 7) / (math.gamma(6) * 7**6) * (1.5 if distance == 0 else 1)
        if weight:
            paths[tuple((lat, lon) for lat, lon, _ in path)] = weight
    return paths


def test_edges_stay_within_reach(spark):
    cells, flights, nodes, hops = nodes_and_links(spark)
    got = {
        (r.id, r.stap_id, r.lat1, r.lon1, r.lat2, r.lon2) for r in trellis.edges(nodes, hops).collect()
    }
    hours = {(t, s): h for t, s, h in flights}
    expected = {
        (a[0], a[1], a[2], a[3], b[2], b[3])
        for a, b in itertools.product(cells, cells)
        if a[0] == b[0] and a[1] + 1 == b[1] and km(a[2:4], b[2:4]) <= hours[a[0], a[1]] * 150
    }
    assert got == expected and trellis.edges(nodes, hops).count() == len(got)


def test_most_likely_path_and_marginal_match_brute_force(spark):
    cells, flights, nodes, hops = nodes_and_links(spark)
    weighted = trellis.edge_weight(trellis.edges(nodes, hops))
    path, shares = {}, {}
    for r in trellis.most_likely(nodes, weighted).collect():
        path.setdefault(r.id, {})[r.stap_id] = (r.lat, r.lon)
    for r in trellis.marginal(nodes, weighted).collect():
        shares[r.id, r.stap_id, r.lat, r.lon] = r.likelihood
    for tag in ("a", "b"):
        paths = brute_force(cells, flights, tag)
        best = max(paths, key=paths.get)
        assert tuple(path[tag][s] for s in sorted(path[tag])) == best
        total = sum(paths.values())
        expected = {}
        for cells_of, weight in paths.items():
            for s, cell in enumerate(cells_of, start=1):
                key = (tag, s, *cell)
                expected[key] = expected.get(key, 0) + weight / total
        got = {k: v for k, v in shares.items() if k[0] == tag}
        assert got.keys() == expected.keys()
        assert all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_gapped_tags_and_tags_without_a_path(spark):
    cells, flights = [], []
    for tag, periods in (("gap", (1, 3, 4, 8)), ("one", (5,)), ("plain", (1, 2, 3)), ("far", (1, 2)), ("dark", (1, 2)), ("none", (1,))):
        rng = random.Random(tag)
        for stap in periods:
            for lat, lon in itertools.product((0.0, 2.0, 4.0), (0.0, 3.0)):
                away = 80.0 if tag == "far" and stap == 2 else 0.0
                cells.append((tag, stap, lat, lon + away, 0.0 if tag == "none" else rng.random()))
        flights += [(tag, stap, None if tag == "dark" else rng.choice([1.0, 2.0, 3.0])) for stap in range(1, 9)]
    flights.append(("unseen", 1, 2.0))
    nodes = spark.createDataFrame(cells, "id string, stap_id int, lat double, lon double, likelihood double")
    hops = spark.createDataFrame(flights, "id string, stap_id int, flight_hours double")
    weighted = trellis.edge_weight(trellis.edges(nodes, hops))
    path = trellis.most_likely(nodes, weighted, hops).collect()
    shares = trellis.marginal(nodes, weighted, hops).collect()
    reasons = {"far": trellis.NO_CHAIN, "dark": trellis.NO_HOURS, "none": trellis.NO_CELL, "unseen": trellis.NO_CELL}
    for rows in (path, shares):
        assert {r.id: r.reason for r in rows if r.stap_id is None} == reasons
        assert {r.id for r in rows if r.stap_id is not None} == {"gap", "one", "plain"}
    for tag, periods in (("gap", (1, 3, 4, 8)), ("one", (5,)), ("plain", (1, 2, 3))):
        dense = {s: k for k, s in enumerate(periods, start=1)}
        renamed = [(t, dense[s], *rest) for t, s, *rest in cells if t == tag]
        summed = [(tag, dense[a], sum(h for t, s, h in flights if t == tag and a <= s < b)) for a, b in zip(periods, periods[1:])]
        paths = brute_force(renamed, summed, tag)
        best, total = max(paths, key=paths.get), sum(paths.values())
        mine = sorted((r.stap_id, r.lat, r.lon) for r in path if r.id == tag)
        assert mine == [(s, *cell) for s, cell in zip(periods, best)]
        assert {round(r.score, 9) for r in path if r.id == tag} == {round(math.log(paths[best]), 9)}
        expected = {}
        for cells_of, weight in paths.items():
            for s, cell in zip(periods, cells_of):
                expected[s, *cell] = expected.get((s, *cell), 0) + weight / total
        got = {(r.stap_id, r.lat, r.lon): r.likelihood for r in shares if r.id == tag}
        assert got.keys() == expected.keys()
        assert all(got[k] == pytest.approx(v) for k, v in expected.items())


@pytest.mark.parametrize("periods", [2, 9, 70])
def test_jobs_grow_with_the_logarithm_of_the_periods(spark, monkeypatch, periods):
    written = []
    write = trellis.keep
    monkeypatch.setattr(trellis, "keep", lambda df: written.append(1) or write(df))
    rng = random.Random(periods)
    cells = [("a", s, lat, 0.0, rng.random()) for s in range(1, periods + 1) for lat in (0.0, 1.0)]
    nodes = spark.createDataFrame(cells, "id string, stap_id int, lat double, lon double, likelihood double")
    hops = nodes.select("id", "stap_id", F.lit(4.0).alias("flight_hours")).distinct()
    weighted = trellis.edge_weight(trellis.edges(nodes, hops))
    path = trellis.most_likely(nodes, weighted).collect()
    assert len(path) == periods and len(written) <= 4 + 2 * math.ceil(math.log2(periods))
    # The best path by stages.
    weight = {(r.stap_id, r.lat1, r.lat2): r.weight for r in weighted.collect()}
    score = {lat: math.log(p) for _, s, lat, _, p in cells if s == 1}
    for stage in range(2, periods + 1):
        own = {lat: p for _, s, lat, _, p in cells if s == stage}
        score = {b: math.log(own[b]) + max(score[a] + math.log(weight[stage - 1, a, b]) for a in score) for b in own}
    assert path[0].score == pytest.approx(max(score.values()))


@pytest.mark.parametrize("lat, lon", [(0.0, 10.0), (70.0, 10.0), (70.0, 179.5), (88.5, 0.0), (-89.0, 90.0)])
def test_edges_on_the_sphere(spark, lat, lon):
    """Around the equator, far north, across the date line and at the poles."""
    rng = random.Random(lat + lon)
    cells = []
    for stap in (1, 2):
        for _ in range(60):
            north = min(90.0, max(-90.0, lat + rng.uniform(-6, 6)))
            cells.append(("a", stap, north, (lon + rng.uniform(-15, 15) + 180) % 360 - 180, 1.0))
    nodes = spark.createDataFrame(cells, "id string, stap_id int, lat double, lon double, likelihood double")
    for hours in (0.5, 3.0, 60.0, 200.0):
        hops = spark.createDataFrame([("a", 1, hours)], "id string, stap_id int, flight_hours double")
        got = trellis.edges(nodes, hops).collect()
        want = {(a[2:4], b[2:4]) for a in cells for b in cells if a[1] == 1 and b[1] == 2 and km(a[2:4], b[2:4]) <= hours * 150}
        assert {((r.lat1, r.lon1), (r.lat2, r.lon2)) for r in got} == want and len(got) == len(want)


def test_pruning_keeps_the_smallest_set(spark):
    df = spark.createDataFrame(
        [("a", 1, float(i), 0.0, p) for i, p in enumerate([0.5, 0.3, 0.15, 0.05, 0.0])],
        "id string, stap_id int, lat double, lon double, likelihood double",
    )
    assert sorted(r.lat for r in grid.prune_cells(df).collect()) == [0.0, 1.0, 2.0]
    assert sorted(r.lat for r in grid.prune_cells(df, 0.8).collect()) == [0.0, 1.0]


def test_known_positions_pin_first_and_last_period(spark):
    staps = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "id string, stap_id int")
    known = spark.createDataFrame([("a", [1, -1], 55.7, 13.43)], "id string, stap_ids array<int>, known_lat double, known_lon double")
    pinned = grid.pin_known(staps, known)
    assert {(r.id, r.stap_id): r.known_lat for r in pinned.collect()} == {
        ("a", 1): 55.7, ("a", 2): None, ("a", 3): 55.7, ("b", 1): None,
    }
    cells = spark.createDataFrame(
        [("a", 1, 55.75, 13.25, 0.1), ("a", 1, 54.75, 13.25, 0.9), ("a", 2, 54.75, 13.25, 0.4)],
        "id string, stap_id int, lat double, lon double, likelihood double",
    )
    got = sorted((r.stap_id, r.lat, r.likelihood) for r in grid.pin_map(cells, pinned, 2).collect())
    assert got == [(1, 54.75, 0.0), (1, 55.75, 1.0), (2, 54.75, 0.4)]


def test_path_between_mapped_periods_is_interpolated(spark):
    times = [(NOON + dt.timedelta(days=d), NOON + dt.timedelta(days=d + 2)) for d in (0, 4, 8)]
    staps = spark.createDataFrame(
        [("a", i + 1, *t) for i, t in enumerate(times)], "id string, stap_id int, start timestamp, end timestamp"
    )
    cells = spark.createDataFrame(
        [("a", 1, 10.0, 0.0, 0.9), ("a", 1, 11.0, 0.0, 0.1), ("a", 3, 20.0, 4.0, 1.0)],
        "id string, stap_id int, lat double, lon double, likelihood double",
    )
    got = [(r.stap_id, r.lat, r.lon, r.interpolated) for r in grid.map_to_path(cells, staps).orderBy("stap_id").collect()]
    assert got == [(1, 10.0, 0.0, False), (2, 15.0, 2.0, True), (3, 20.0, 4.0, False)]


def test_refresh_replaces_changed_periods_only(spark):
    schema = "id string, stap_id int, lat double, likelihood double"
    old = spark.createDataFrame([("a", 1, 1.0, 0.1), ("a", 2, 1.0, 0.2)], schema)
    new = spark.createDataFrame([("a", 1, 2.0, 0.9), ("a", 2, 2.0, 0.8)], schema)
    changed = spark.createDataFrame([("a", 2)], "id string, stap_id int")
    got = sorted(tuple(r) for r in grid.refresh_map(old, new, changed).collect())
    assert got == [("a", 1, 1.0, 0.1), ("a", 2, 2.0, 0.8)]


def test_altitude_above_a_cell(spark):
    path = spark.createDataFrame([("a", 1, 50.0, 10.0)], "id string, stap_id int, lat double, lon double")
    press = spark.createDataFrame([("a", 1, NOON, 900.0)], "id string, stap_id int, date timestamp, pressure_hpa double")
    era = spark.createDataFrame(
        [(50.0, 10.0, NOON, 100.0, 1000.0, 288.0)],
        "lat double, lon double, ts timestamp, altitude double, surface_pressure double, temperature_2m double",
    )
    out = grid.pressure_path(path, press, era)
    assert out.first().tag_altitude == pytest.approx(100 + 288 / 0.0065 * ((1000 / 900) ** 0.190263 - 1))
    assert [(r.bin, r.n) for r in grid.residual_hist(out).collect()] == [(-100.0, 1)]
