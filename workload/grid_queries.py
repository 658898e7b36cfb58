"""Stationary periods, grid maps and paths.

Pressure samples come from ``orders`` (priority = tag, year = stationary
period), gridded pressure from ``lineitem`` (line number and return flag =
cell), the movement trellis from ``customer`` (nation = tag, market segment =
stationary period).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from featherline.operators import grid, trellis
from workload import adaptors
from workload.adaptors import rounded, table
from workload.registry import query, step

step(
    "stap_run",
    """
SELECT id, date, is_flight,
       sum(CASE WHEN NOT is_flight AND coalesce(before, true) THEN 1 ELSE 0 END)
         OVER (PARTITION BY id ORDER BY date)::BIGINT AS stap_id
FROM (SELECT user_id AS id, ts AS date, event_type = 'signup' AS is_flight,
             lag(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts) AS before
      FROM events)
""",
)


@query(
    "stationary_periods",
    """
SELECT id, stap_id, start, stop AS end, n, round((epoch_us(stop) - epoch_us(start)) / 3.6e9, 6) AS duration_hours,
       (epoch_us(stop) - epoch_us(start)) / 3.6e9 >= 24 AS include
FROM (SELECT id, stap_id, min(date) AS start, max(date) AS stop, count(*) AS n
      FROM stap_run WHERE NOT is_flight GROUP BY ALL)
""",
)
def stationary_periods(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"),
        F.col("ts").alias("date"),
        (F.col("event_type") == "signup").alias("is_flight"),
    )
    return grid.staps(rows, 24).withColumn("duration_hours", rounded("duration_hours"))


step(
    "extent",
    """
SELECT s_suppkey AS id, s_nationkey::DOUBLE AS west, s_nationkey + 4.0::DOUBLE AS east,
       -s_nationkey::DOUBLE AS south, 6.0::DOUBLE - s_nationkey AS north, (1 + s_suppkey % 2)::INT AS scale
FROM supplier
""",
)


@query(
    "grid_cells",
    """
SELECT id, lat, west + (unnest(generate_series(0, ((east - west) * scale)::INT - 1)) + 0.5) / scale AS lon
FROM (SELECT *, south + (unnest(generate_series(0, ((north - south) * scale)::INT - 1)) + 0.5) / scale AS lat
      FROM extent)
""",
)
def grid_cells(spark, sf_dir):
    nation = F.col("s_nationkey").cast("double")
    extents = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        nation.alias("west"),
        (nation + 4).alias("east"),
        (-nation).alias("south"),
        (6 - nation).alias("north"),
        (1 + F.col("s_suppkey") % 2).cast("int").alias("scale"),
    )
    return grid.grid(extents).withColumns({"lat": rounded("lat"), "lon": rounded("lon")})


step(
    "tag_pressure",
    """
SELECT o_orderpriority AS id, year(o_orderdate)::INT AS stap_id, o_orderdate AS date,
       1000 - avg(o_totalprice) / 20000 AS pressure_hpa
FROM orders GROUP BY ALL
""",
)
step(
    "reanalysis",
    """
SELECT l_linenumber::DOUBLE AS lat, ascii(l_returnflag)::DOUBLE AS lon, l_shipdate AS ts,
       1000 - avg(l_quantity) / 2 AS surface_pressure, avg(l_discount) * 1000 AS altitude,
       280 + avg(l_tax) * 100 AS temperature_2m
FROM lineitem GROUP BY ALL
""",
)


def tag_pressure(spark, sf_dir):
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("id"),
            F.year("o_orderdate").alias("stap_id"),
            F.col("o_orderdate").alias("date"),
        )
        .agg((1000 - F.avg("o_totalprice") / 20000).alias("pressure_hpa"))
    )


def reanalysis(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.col("l_linenumber").cast("double").alias("lat"),
            F.ascii("l_returnflag").cast("double").alias("lon"),
            F.col("l_shipdate").alias("ts"),
        )
        .agg(
            (1000 - F.avg("l_quantity") / 2).alias("surface_pressure"),
            (F.avg("l_discount") * 1000).alias("altitude"),
            (280 + F.avg("l_tax") * 100).alias("temperature_2m"),
        )
    )


step(
    "pressure_cell",
    """
SELECT *, CASE WHEN share >= 0.55 THEN exp(-ln(n) * mse / (2 * 8 * 8)) ELSE 0 END AS likelihood
FROM (SELECT id, stap_id, lat, lon, count(*) AS n, var_pop(pressure_hpa - surface_pressure) AS mse,
             avg((abs(pressure_hpa - surface_pressure) <= 10)::INT) AS share
      FROM tag_pressure JOIN reanalysis ON date = ts GROUP BY ALL)
""",
)


def pressure_cells(spark, sf_dir):
    return grid.pressure_map(
        tag_pressure(spark, sf_dir), reanalysis(spark, sf_dir), sd=8, margin=10, thr_mask=0.55
    )


@query(
    "pressure_map",
    """
SELECT id, stap_id, lat, lon, n, round(mse, 6) AS mse, round(share, 6) AS share_in_range,
       round(likelihood, 6) AS likelihood
FROM pressure_cell
""",
)
def pressure_map(spark, sf_dir):
    return pressure_cells(spark, sf_dir).withColumns(
        {c: rounded(c) for c in ("mse", "share_in_range", "likelihood")}
    )


def tag_extents(spark, sf_dir):
    """An extent of each tag, moved east and north with the first figure of its name."""
    n = F.substring("o_orderpriority", 1, 1).cast("double")
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("id"))
        .agg(
            F.max(n + 64).alias("west"),
            F.max(n + 76).alias("east"),
            F.max(n / 2).alias("south"),
            F.max(n / 2 + 3).alias("north"),
        )
    )


@query(
    "pressure_map_in_extents",
    """
SELECT id, stap_id, lat, lon, n, round(mse, 6) AS mse, round(share, 6) AS share_in_range,
       round(likelihood, 6) AS likelihood
FROM pressure_cell
WHERE lon BETWEEN substr(id, 1, 1)::DOUBLE + 64 AND substr(id, 1, 1)::DOUBLE + 76
  AND lat BETWEEN substr(id, 1, 1)::DOUBLE / 2 AND substr(id, 1, 1)::DOUBLE / 2 + 3
""",
)
def pressure_map_in_extents(spark, sf_dir):
    return grid.pressure_map(
        tag_pressure(spark, sf_dir),
        reanalysis(spark, sf_dir),
        sd=8,
        margin=10,
        thr_mask=0.55,
        extents=tag_extents(spark, sf_dir),
        block=2.0,
    ).withColumns({c: rounded(c) for c in ("mse", "share_in_range", "likelihood")})


@query(
    "light_twilights",
    """
SELECT id, day, 'Rise' AS series, min(ts) AS timestamp
FROM (SELECT user_id AS id, ts, value, (ts - INTERVAL 2 HOUR)::DATE AS day FROM events) WHERE value > 10 GROUP BY ALL
UNION ALL
SELECT id, day, 'Set' AS series, max(ts) AS timestamp
FROM (SELECT user_id AS id, ts, value, (ts - INTERVAL 2 HOUR)::DATE AS day FROM events) WHERE value > 10 GROUP BY ALL
""",
)
def light_twilights(spark, sf_dir):
    light = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), "ts", F.col("value").alias("lux")
    )
    return grid.twilights(light, 2, 10)


def zenith_sql(ts: str, lat: str, lon: str) -> str:
    """The solar zenith in SQL, spelled out from the almanac formulas."""
    d = f"(epoch_us({ts}) / 8.64e10 - 10957.5)"
    g = f"radians(357.529 + 0.98560028 * {d})"
    q0 = f"(280.459 + 0.98564736 * {d})"
    q = f"({q0} - 360 * floor({q0} / 360))"
    lam = f"radians({q} + 1.915 * sin({g}) + 0.020 * sin(2 * {g}))"
    e = f"radians(23.439 - 0.00000036 * {d})"
    dec = f"asin(sin({e}) * sin({lam}))"
    asc = f"degrees(atan2(cos({e}) * sin({lam}), cos({lam})))"
    w0 = f"({q} - {asc} + 180)"
    eq = f"(({w0} - 360 * floor({w0} / 360)) - 180) * 4"
    m0 = f"(epoch_us({ts}) / 6e7)"
    h = f"radians((({m0} - 1440 * floor({m0} / 1440)) + {eq}) / 4 + {lon} - 180)"
    cosine = f"sin(radians({lat})) * sin({dec}) + cos(radians({lat})) * cos({dec}) * cos({h})"
    return f"degrees(acos(greatest(-1, least(1, {cosine}))))"


step(
    "twilight_at",
    """
SELECT user_id AS id, user_id % 3 AS stap_id, min(ts) AS timestamp
FROM events GROUP BY user_id, ts::DATE
""",
)
step(
    "tag_cell",
    """
SELECT id, unnest([id % 50 - 20.0::DOUBLE, id % 50 - 10.0::DOUBLE, id % 50 + 0.0::DOUBLE]) AS lat, lon
FROM (SELECT DISTINCT user_id AS id, unnest([5.0::DOUBLE, 25.0::DOUBLE, 45.0::DOUBLE]) AS lon FROM events)
""",
)
step(
    "calib",
    f"""
SELECT bin, count(*) / (sum(count(*)) OVER () * 2.0) AS density
FROM (SELECT round_even({zenith_sql("timestamp", "20.0", "15.0")} / 2, 0)::INT AS bin FROM twilight_at) GROUP BY bin
""",
)
step(
    "light_cell",
    f"""
SELECT id, stap_id, lat, lon, n, exp(ln(n) / n * s) AS likelihood
FROM (SELECT z.id, z.stap_id, z.lat, z.lon, count(*) AS n, sum(ln(greatest(coalesce(c.density, 1e-4), 1e-4))) AS s
      FROM (SELECT t.id, t.stap_id, g.lat, g.lon,
                   round_even({zenith_sql("t.timestamp", "g.lat", "g.lon")} / 2, 0)::INT AS bin
            FROM twilight_at t JOIN tag_cell g ON t.id = g.id) z
      LEFT JOIN calib c ON z.bin = c.bin GROUP BY ALL)
""",
)


def _twilight_at(spark, sf_dir):
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("_day"))
        .agg(F.min("ts").alias("timestamp"))
        .select("id", (F.col("id") % 3).alias("stap_id"), "timestamp")
    )


def light_cells(spark, sf_dir):
    twilight = _twilight_at(spark, sf_dir)
    base = (F.col("id") % 50).cast("double")
    cells = (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("id"))
        .distinct()
        .withColumn("lat", F.explode(F.array(base - 20, base - 10, base + 0)))
        .withColumn("lon", F.explode(F.array(F.lit(5.0), F.lit(25.0), F.lit(45.0))))
    )
    known = twilight.withColumns({"lat": F.lit(20.0), "lon": F.lit(15.0)})
    return grid.light_map(twilight, cells, grid.calibration(known, 2.0), 2.0)


@query(
    "twilight_calibration",
    "SELECT bin, round(density, 6) AS density FROM calib",
)
def twilight_calibration(spark, sf_dir):
    known = _twilight_at(spark, sf_dir).withColumns({"lat": F.lit(20.0), "lon": F.lit(15.0)})
    return grid.calibration(known, 2.0).withColumn("density", rounded("density"))


@query(
    "light_map",
    "SELECT id, stap_id, lat, lon, n, round(likelihood, 6) AS likelihood FROM light_cell",
)
def light_map(spark, sf_dir):
    return light_cells(spark, sf_dir).select(
        "id", "stap_id", "lat", "lon", "n", rounded("likelihood").alias("likelihood")
    )


step(
    "node",
    """
SELECT c_nationkey AS id, strpos('ABFHM', left(c_mktsegment, 1))::INT AS stap_id,
       floor(c_acctbal / 1000)::DOUBLE * 2 AS lat, (c_custkey % 11)::DOUBLE * 3 AS lon,
       sum(c_acctbal + 1000) / 1000 AS likelihood
FROM customer GROUP BY ALL
""",
)


def segment_number():
    return F.expr("instr('ABFHM', left(c_mktsegment, 1))")


def nodes(spark, sf_dir):
    return (
        table(spark, sf_dir, "customer")
        .groupBy(
            F.col("c_nationkey").alias("id"),
            segment_number().alias("stap_id"),
            (F.floor(F.col("c_acctbal") / 1000).cast("double") * 2).alias("lat"),
            ((F.col("c_custkey") % 11).cast("double") * 3).alias("lon"),
        )
        .agg((F.sum(F.col("c_acctbal") + 1000) / 1000).alias("likelihood"))
    )


PRUNED = """
SELECT id, stap_id, lat, lon, likelihood FROM (
  SELECT *, sum(likelihood) OVER (PARTITION BY id, stap_id) AS total,
         coalesce(sum(likelihood) OVER (PARTITION BY id, stap_id ORDER BY likelihood DESC, lat, lon
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM node) WHERE likelihood > 0 AND before < 0.9 * total
"""
step("pruned", PRUNED)


@query(
    "pruned_cells",
    "SELECT id, stap_id, lat, lon, round(likelihood, 5) AS likelihood FROM pruned",
)
def pruned_cells(spark, sf_dir):
    return grid.prune_cells(nodes(spark, sf_dir)).withColumn("likelihood", rounded("likelihood", 5))


def haversine_sql() -> str:
    return (
        "2 * 6371 * asin(least(1, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat))"
        " * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
    )


step("tag", "SELECT DISTINCT id FROM node")
step(
    "kept",
    """
SELECT *, row_number() OVER w AS stage, lead(stap_id) OVER w AS next_stap, count(*) OVER (PARTITION BY id) AS n
FROM (SELECT DISTINCT id, stap_id FROM pruned) WINDOW w AS (PARTITION BY id ORDER BY stap_id)
""",
)
step(
    "hop",
    """
SELECT k.id, k.stap_id, k.stage, k.next_stap, sum(f.hours) AS flight_hours
FROM kept k JOIN (SELECT DISTINCT id, stap_id, 4.0::DOUBLE + (id % 4) * 2 AS hours FROM node) f
  ON f.id = k.id AND f.stap_id >= k.stap_id AND f.stap_id < k.next_stap
GROUP BY ALL
""",
)
step(
    "edge",
    f"""
SELECT a.id, a.stap_id, h.stage, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2,
       {haversine_sql()} AS km, {haversine_sql()} / h.flight_hours AS speed
FROM hop h JOIN pruned a ON a.id = h.id AND a.stap_id = h.stap_id
JOIN pruned b ON b.id = h.id AND b.stap_id = h.next_stap
WHERE {haversine_sql()} <= h.flight_hours * 150
""",
)
step(
    "weighted",
    """
SELECT *, (CASE WHEN speed = 0 THEN 1.5 ELSE 1 END)
          * pow(greatest(speed, 20), 5) * exp(-greatest(speed, 20) / 7) / (120 * pow(7, 6)) AS weight
FROM edge
""",
)


def _pruned(spark, sf_dir):
    return grid.prune_cells(nodes(spark, sf_dir))


def _flights(spark, sf_dir):
    hours = (4.0 + (F.col("id") % 4) * 2).alias("flight_hours")
    return nodes(spark, sf_dir).select("id", "stap_id", hours).distinct()


def _edges(spark, sf_dir, cells):
    return trellis.edge_weight(trellis.edges(cells, _flights(spark, sf_dir)))


@query(
    "movement_edges",
    """
SELECT id, stap_id, lat1, lon1, lat2, lon2, round(km, 4) AS distance_km, round(speed, 4) AS speed,
       round(weight, 8) AS weight
FROM weighted
""",
)
def movement_edges(spark, sf_dir):
    return _edges(spark, sf_dir, _pruned(spark, sf_dir)).select(
        "id",
        "stap_id",
        "lat1",
        "lon1",
        "lat2",
        "lon2",
        rounded("distance_km", 4).alias("distance_km"),
        rounded("speed", 4).alias("speed"),
        rounded("weight", 8).alias("weight"),
    )


STAGES = range(1, 6)
step("staged", "SELECT p.*, stage, n FROM pruned p JOIN kept USING (id, stap_id)")
HERE = "{'stap_id': n.stap_id, 'lat': n.lat, 'lon': n.lon}"

# Best score into every node, and the path to it, stage by stage.
for k in STAGES:
    step(
        f"score{k}",
        f"""
SELECT n.id, n.lat, n.lon, max(s.score + ln(w.weight)) + any_value(ln(n.likelihood)) AS score,
       list_append(arg_max(s.path, s.score + ln(w.weight)), any_value({HERE})) AS path
FROM staged n JOIN weighted w ON n.id = w.id AND n.stage = w.stage + 1 AND n.lat = w.lat2 AND n.lon = w.lon2
JOIN score{k - 1} s ON s.id = w.id AND s.lat = w.lat1 AND s.lon = w.lon1
WHERE n.stage = {k} GROUP BY n.id, n.lat, n.lon
"""
        if k > 1
        else f"SELECT id, lat, lon, ln(likelihood) AS score, [{HERE}] AS path FROM staged n WHERE stage = 1",
    )
step(
    "best_path",
    " UNION ALL ".join(
        f"SELECT s.id, max(s.score) AS score, arg_max(s.path, s.score) AS path FROM score{k} s"
        f" WHERE s.id IN (SELECT id FROM kept WHERE n = {k}) GROUP BY s.id"
        for k in STAGES
    ),
)
step(
    "no_path",
    """
SELECT id, CASE WHEN id IN (SELECT id FROM pruned) THEN 'no chain of reachable cells' ELSE 'no likely cell' END AS reason
FROM tag WHERE id NOT IN (SELECT id FROM best_path)
""",
)


def _path(spark, sf_dir):
    cells = _pruned(spark, sf_dir)
    return trellis.most_likely(cells, _edges(spark, sf_dir, cells), _flights(spark, sf_dir))


@query(
    "most_likely_path",
    """
SELECT id, p.stap_id AS stap_id, p.lat AS lat, p.lon AS lon, NULL::VARCHAR AS reason
FROM (SELECT id, unnest(path) AS p FROM best_path)
UNION ALL SELECT id, NULL, NULL, NULL, reason FROM no_path
""",
)
def most_likely_path(spark, sf_dir):
    return _path(spark, sf_dir).select("id", "stap_id", "lat", "lon", "reason")


@query(
    "most_likely_score",
    "SELECT id, round(score, 5) AS score FROM tag LEFT JOIN best_path USING (id)",
)
def most_likely_score(spark, sf_dir):
    return _path(spark, sf_dir).groupBy("id").agg(rounded(F.max("score"), 5).alias("score"))


# The path's own score, added up from its cells and edges, must be the best score.
@query(
    "most_likely_path_score",
    "SELECT id, round(score, 5) AS path_score FROM best_path",
)
def most_likely_path_score(spark, sf_dir):
    cells = _pruned(spark, sf_dir)
    links = _edges(spark, sf_dir, cells)
    path = trellis.most_likely(cells, links).select("id", "stap_id", "lat", "lon")
    own = path.join(cells, ["id", "stap_id", "lat", "lon"]).select("id", F.log("likelihood").alias("v"))
    ahead = path.withColumnsRenamed({"stap_id": "next_stap", "lat": "lat2", "lon": "lon2"})
    steps = (
        path.withColumnsRenamed({"lat": "lat1", "lon": "lon1"})
        .join(links, ["id", "stap_id", "lat1", "lon1"])
        .join(ahead, ["id", "next_stap", "lat2", "lon2"])
        .select("id", F.log("weight").alias("v"))
    )
    return own.unionByName(steps).groupBy("id").agg(rounded(F.sum("v"), 5).alias("path_score"))


for k in STAGES:
    step(
        f"ahead{k}",
        f"""
SELECT n.id, n.stap_id, n.lat, n.lon, sum(s.p * w.weight) * any_value(n.likelihood) AS p
FROM staged n JOIN weighted w ON n.id = w.id AND n.stage = w.stage + 1 AND n.lat = w.lat2 AND n.lon = w.lon2
JOIN ahead{k - 1} s ON s.id = w.id AND s.lat = w.lat1 AND s.lon = w.lon1
WHERE n.stage = {k} GROUP BY ALL
"""
        if k > 1
        else "SELECT id, stap_id, lat, lon, likelihood AS p FROM staged WHERE stage = 1",
    )
for k in reversed(STAGES):
    into = f"""
UNION ALL
SELECT w.id, w.lat1 AS lat, w.lon1 AS lon, sum(s.p * w.weight * n.likelihood) AS p
FROM weighted w JOIN back{k + 1} s ON s.id = w.id AND s.lat = w.lat2 AND s.lon = w.lon2
JOIN staged n ON n.id = w.id AND n.stage = {k + 1} AND n.lat = w.lat2 AND n.lon = w.lon2
WHERE w.stage = {k} GROUP BY ALL
"""
    step(f"back{k}", f"SELECT id, lat, lon, 1.0::DOUBLE AS p FROM staged WHERE stage = {k} AND n = {k}" + (into if k < 5 else ""))


@query(
    "marginal_map",
    "SELECT id, stap_id, lat, lon, round(p / sum(p) OVER (PARTITION BY id, stap_id), 6) AS likelihood, NULL::VARCHAR AS reason FROM ("
    + " UNION ALL ".join(
        f"SELECT a.id, a.stap_id, a.lat, a.lon, a.p * b.p AS p FROM ahead{k} a JOIN back{k} b"
        " ON a.id = b.id AND a.lat = b.lat AND a.lon = b.lon"
        for k in STAGES
    )
    + ") UNION ALL SELECT id, NULL, NULL, NULL, NULL, reason FROM no_path",
)
def marginal_map(spark, sf_dir):
    cells = _pruned(spark, sf_dir)
    found = trellis.marginal(cells, _edges(spark, sf_dir, cells), _flights(spark, sf_dir))
    return found.withColumn("likelihood", rounded("likelihood"))


step(
    "best_cell",
    """
SELECT id, stap_id, lat, lon FROM (
  SELECT *, row_number() OVER (PARTITION BY id, stap_id ORDER BY likelihood DESC, lat DESC, lon DESC) AS rn
  FROM pressure_cell) WHERE rn = 1
""",
)


@query("map_path", "SELECT id, stap_id, lat, lon FROM best_cell")
def map_path(spark, sf_dir):
    return grid.map_to_path(pressure_cells(spark, sf_dir))


step(
    "path_span",
    "SELECT id, stap_id, (epoch_us(min(date)::TIMESTAMP) + epoch_us(max(date)::TIMESTAMP)) / 2 AS mid FROM tag_pressure GROUP BY ALL",
)
step(
    "path_known",
    """
SELECT s.*, b.lat, b.lon, CASE WHEN b.lat IS NOT NULL THEN mid END AS spot
FROM path_span s LEFT JOIN best_cell b ON s.id = b.id AND s.stap_id = b.stap_id AND b.stap_id % 2 = 0
""",
)
step(
    "path_near",
    """
SELECT *, coalesce((mid - t0) / nullif(t1 - t0, 0), 0) AS part
FROM (SELECT *, max(spot) OVER (PARTITION BY id ORDER BY stap_id) AS t0,
             min(spot) OVER (PARTITION BY id ORDER BY stap_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1
      FROM path_known)
""",
)


@query(
    "path_between_maps",
    """
SELECT v.id, v.stap_id, round(coalesce(v.lat, a.lat + (b.lat - a.lat) * part, a.lat, b.lat), 6) AS lat,
       round(coalesce(v.lon, a.lon + (b.lon - a.lon) * part, a.lon, b.lon), 6) AS lon, v.lat IS NULL AS interpolated
FROM path_near v LEFT JOIN path_known a ON v.id = a.id AND v.t0 = a.spot LEFT JOIN path_known b ON v.id = b.id AND v.t1 = b.spot
""",
)
def path_between_maps(spark, sf_dir):
    """Periods of even numbers have a map, the others lie between them."""
    pressure = tag_pressure(spark, sf_dir)
    periods = pressure.groupBy("id", "stap_id").agg(F.min("date").alias("start"), F.max("date").alias("end"))
    path = grid.map_to_path(pressure_cells(spark, sf_dir).where("stap_id % 2 = 0"), periods)
    return path.withColumns({c: rounded(c) for c in ("lat", "lon")})


@query(
    "pinned_map",
    """
SELECT c.id, c.stap_id, c.lat, c.lon,
       round(CASE WHEN k.id IS NULL THEN likelihood
                  WHEN abs(c.lat - known_lat) <= 0.5 AND abs(c.lon - 78.3) <= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 6) AS likelihood
FROM pressure_cell c
LEFT JOIN (SELECT id, unnest([1993, max(stap_id)]) AS stap_id, substr(id, 1, 1)::DOUBLE + 0.2 AS known_lat FROM pressure_cell GROUP BY id) k
ON c.id = k.id AND c.stap_id = k.stap_id
""",
)
def pinned_map(spark, sf_dir):
    """Pressure maps with the second year and the last one at known places."""
    cells = pressure_cells(spark, sf_dir)
    periods = cells.select("id", "stap_id").distinct()
    known = periods.select("id").distinct().select(
        "id",
        F.array(F.lit(1993), F.lit(-1)).alias("stap_ids"),
        (F.substring("id", 1, 1).cast("double") + 0.2).alias("known_lat"),
        F.lit(78.3).alias("known_lon"),
    )
    pinned = grid.pin_map(cells, grid.pin_known(periods, known), scale=1.0)
    return pinned.select("id", "stap_id", "lat", "lon", rounded("likelihood").alias("likelihood"))


step(
    "path_press",
    """
SELECT p.id, p.stap_id, p.date AS ts, p.pressure_hpa - r.surface_pressure AS pressure_diff,
       r.altitude + r.temperature_2m / 0.0065 * (pow(r.surface_pressure / p.pressure_hpa, 0.190263) - 1) AS tag_altitude
FROM tag_pressure p JOIN best_cell b ON p.id = b.id AND p.stap_id = b.stap_id
LEFT JOIN reanalysis r ON p.date = r.ts AND b.lat = r.lat AND b.lon = r.lon
""",
)


def _path_press(spark, sf_dir):
    path = grid.map_to_path(pressure_cells(spark, sf_dir))
    return grid.pressure_path(path, tag_pressure(spark, sf_dir), reanalysis(spark, sf_dir))


@query(
    "pressure_path",
    """
SELECT id, stap_id, ts, round(pressure_diff, 5) AS pressure_diff, round(tag_altitude, 4) AS tag_altitude FROM path_press
""",
)
def pressure_path(spark, sf_dir):
    return _path_press(spark, sf_dir).select(
        "id",
        "stap_id",
        "ts",
        rounded("pressure_diff", 5).alias("pressure_diff"),
        rounded("tag_altitude", 4).alias("tag_altitude"),
    )


@query(
    "pressure_residuals",
    """
SELECT id, stap_id, round_even(pressure_diff / 2, 0) * 2 + 0.0::DOUBLE AS bin, count(*) AS n
FROM path_press WHERE pressure_diff IS NOT NULL GROUP BY ALL
""",
)
def pressure_residuals(spark, sf_dir):
    return grid.residual_hist(_path_press(spark, sf_dir), 2.0).withColumn("bin", F.col("bin") + 0.0)


@query(
    "combined_map",
    """
SELECT id, stap_id, lat, lon, round(p / sum(p) OVER (PARTITION BY id, stap_id), 6) AS likelihood
FROM (SELECT a.id, a.stap_id, a.lat, a.lon, a.likelihood * b.likelihood AS p
      FROM node a JOIN pruned b ON a.id = b.id AND a.stap_id = b.stap_id AND a.lat = b.lat AND a.lon = b.lon)
""",
)
def combined_map(spark, sf_dir):
    return grid.combine_maps(nodes(spark, sf_dir), _pruned(spark, sf_dir)).withColumn(
        "likelihood", rounded("likelihood")
    )


@query(
    "refreshed_map",
    """
SELECT id, stap_id, lat, lon, round(likelihood, 5) AS likelihood FROM node
WHERE (id, stap_id) NOT IN (SELECT c_nationkey, strpos('ABFHM', left(c_mktsegment, 1)) FROM customer WHERE c_acctbal < -900)
UNION ALL
SELECT id, stap_id, lat, lon, round(likelihood, 5) AS likelihood FROM pruned
WHERE (id, stap_id) IN (SELECT c_nationkey, strpos('ABFHM', left(c_mktsegment, 1)) FROM customer WHERE c_acctbal < -900)
""",
)
def refreshed_map(spark, sf_dir):
    changed = (
        table(spark, sf_dir, "customer")
        .where(F.col("c_acctbal") < -900)
        .select(
            F.col("c_nationkey").alias("id"), segment_number().alias("stap_id")
        )
    )
    return grid.refresh_map(nodes(spark, sf_dir), _pruned(spark, sf_dir), changed).withColumn(
        "likelihood", rounded("likelihood", 5)
    )


@query(
    "pinned_periods",
    """
SELECT s.id, s.stap_id, k.known_lat, k.known_lon
FROM (SELECT id, stap_id FROM stap_run WHERE NOT is_flight GROUP BY ALL) s
LEFT JOIN (SELECT id, unnest([1, max(stap_id)]) AS stap_id, 55.0::DOUBLE + id % 7 AS known_lat, 13.0::DOUBLE AS known_lon
           FROM stap_run WHERE NOT is_flight GROUP BY id HAVING max(stap_id) > 1
           UNION ALL
           SELECT id, 1, 55.0::DOUBLE + id % 7, 13.0::DOUBLE FROM stap_run WHERE NOT is_flight
           GROUP BY id HAVING max(stap_id) = 1) k
ON s.id = k.id AND s.stap_id = k.stap_id
""",
)
def pinned_periods(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.col("user_id").alias("id"),
        F.col("ts").alias("date"),
        (F.col("event_type") == "signup").alias("is_flight"),
    )
    known = rows.select("id").distinct().select(
        "id",
        F.expr("array(1L, -1L)").alias("stap_ids"),
        (55.0 + F.col("id") % 7).alias("known_lat"),
        F.lit(13.0).alias("known_lon"),
    )
    return grid.pin_known(grid.staps(rows), known).select("id", "stap_id", "known_lat", "known_lon")


def declination_sql(ts: str) -> tuple[str, str]:
    d = f"(epoch_us({ts}) / 8.64e10 - 10957.5)"
    g = f"radians(357.529 + 0.98560028 * {d})"
    q0 = f"(280.459 + 0.98564736 * {d})"
    q = f"({q0} - 360 * floor({q0} / 360))"
    lam = f"radians({q} + 1.915 * sin({g}) + 0.020 * sin(2 * {g}))"
    e = f"radians(23.439 - 0.00000036 * {d})"
    asc = f"degrees(atan2(cos({e}) * sin({lam}), cos({lam})))"
    w0 = f"({q} - {asc} + 180)"
    return f"asin(sin({e}) * sin({lam}))", f"((({w0} - 360 * floor({w0} / 360)) - 180) * 4)"


DEC, EQ = declination_sql("(date::TIMESTAMP + INTERVAL 12 HOUR)")


@query(
    "path_twilights",
    f"""
SELECT id, date, lat, lon,
       date::TIMESTAMP + to_seconds(round((720 - lon * 4 - eq - half) * 60)) AS sunrise,
       date::TIMESTAMP + to_seconds(round((720 - lon * 4 - eq + half) * 60)) AS sunset
FROM (SELECT *, CASE WHEN abs(c) <= 1 THEN degrees(acos(c)) * 4 END AS half
      FROM (SELECT *, (sin(radians(-0.833)) - sin(radians(lat)) * sin(dec)) / (cos(radians(lat)) * cos(dec)) AS c
            FROM (SELECT id, date::DATE AS date, lat, lon, {DEC.replace("date::", "date::DATE::")} AS dec,
                         {EQ.replace("date::", "date::DATE::")} AS eq FROM path_rows)))
""",
)
def path_twilights(spark, sf_dir):
    path = adaptors.path(spark, sf_dir).select("id", F.to_date("date").alias("date"), "lat", "lon")
    return grid.path_twilight(path)
