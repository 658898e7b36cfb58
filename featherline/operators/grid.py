"""Position likelihood on a grid, from pressure and from light.

Follows the published description of pressure and light geolocation; the maps
have columns ``id, stap_id, lat, lon, likelihood``.  A stationary period has at
most as many rows as the tag's grid has cells, which bounds the windows here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featherline.functions.geo import solar_zenith, sun_declination_and_time
from featherline.functions.times import hours_between, minutes
from featherline.operators import series

CELL = ["lat", "lon"]

# Fixed values of the standard atmosphere: lapse rate in K/m and the exponent R * L / (g * M).
LAPSE_RATE = 0.0065
EXPONENT = 0.190263


def _pressure_at(altitude: str) -> Column:
    """Air pressure at another altitude above the same cell."""
    rise = F.col(altitude) - F.col("altitude")
    base = 1 - LAPSE_RATE * rise / F.col("temperature_2m")
    return F.col("surface_pressure") * F.pow(base, F.lit(1 / EXPONENT))


def staps(labelled: DataFrame, min_hours: float = 0, max_rows: int = series.MAX_ROWS) -> DataFrame:
    """Stationary periods: runs of rows without flight, with time span and inclusion flag.

    `labelled` has ``id, date, is_flight``.
    """
    df = series.split_hot(labelled, max_rows=max_rows)
    df = series.neighbours(df, {"_prev": F.col("is_flight")})
    starts = ~F.col("is_flight") & F.coalesce(F.col("_prev"), F.lit(True))
    df = series.running_sum(df, {"stap_id": F.when(starts, 1).otherwise(0)})
    return (
        df.where(~F.col("is_flight"))
        .groupBy("id", "stap_id")
        .agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("n"))
        .withColumn("duration_hours", hours_between(F.col("start"), F.col("end")))
        .withColumn("include", F.col("duration_hours") >= min_hours)
    )


def grid(extents: DataFrame) -> DataFrame:
    """Cell centres per tag; `extents` has ``id, west, east, south, north, scale`` (cells per degree)."""

    def centres(low: str, high: str) -> Column:
        cells = ((F.col(high) - F.col(low)) * F.col("scale")).cast("int")
        return F.transform(
            F.sequence(F.lit(0), cells - 1), lambda i: F.col(low) + (i + 0.5) / F.col("scale")
        )

    lat_rows = extents.withColumn("lat", F.explode(centres("south", "north")))
    return lat_rows.select("id", "lat", F.explode(centres("west", "east")).alias("lon"))


def pressure_map(
    pressure: DataFrame,
    reanalysis: DataFrame,
    sd: float = 0.8,
    margin: float = 10,
    thr_mask: float = 0.9,
    weight: str = "ln(n)/n",
    extents: DataFrame | None = None,
    block: float = 10.0,
    rows_per_key: int = 1000,
) -> DataFrame:
    """Match of each stationary period's pressure with every cell of its tag's extent.

    `extents` has ``id, west, east, south, north``, borders included; an extent may
    cross the 180th meridian with west > east.  Tags without extent, and all tags if
    there is none, are matched with every cell.

    A sample goes only to the blocks of cells (`block` degrees wide) that its extent
    touches, and samples of one hour are dealt into parts of about `rows_per_key`, so
    that no join key holds a whole hour.  What the parts know of a period and a cell
    (count, mean and squared deviations) is merged by the aggregate.

    The error is the variance of the difference, so a constant altitude offset
    costs nothing.  A cell counts only if enough samples lie within `margin` of
    the pressures between its lowest and highest ground; without the columns
    ``altitude_min`` and ``altitude_max`` that is the surface pressure alone.
    """
    low, high = F.col("surface_pressure"), F.col("surface_pressure")
    if {"altitude_min", "altitude_max"} <= set(reanalysis.columns):
        low, high = _pressure_at("altitude_max"), _pressure_at("altitude_min")
    cells = reanalysis.select(
        "ts", *CELL, "surface_pressure", (low - margin).alias("_low"), (high + margin).alias("_high")
    )
    samples = pressure.select("id", "stap_id", F.col("date").alias("ts"), "pressure_hpa")
    heaviest = samples.groupBy("ts").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-heaviest // rows_per_key))
    cells = cells.withColumns(
        {
            "_lat_block": F.floor(F.col("lat") / block),
            "_lon_block": F.floor(F.col("lon") / block),
            "_part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))),
        }
    )
    samples = _to_blocks(samples, reanalysis, extents, block).withColumn(
        "_part", F.pmod(F.xxhash64("id", "stap_id", "pressure_hpa"), F.lit(parts)).cast("int")
    )
    difference = F.col("pressure_hpa") - F.col("surface_pressure")
    in_range = F.col("pressure_hpa").between(F.col("_low"), F.col("_high"))
    matched = (
        samples.join(cells, ["ts", "_lat_block", "_lon_block", "_part"])
        .where(F.col("lat").between(F.col("_south"), F.col("_north")))
        .where(
            F.when(F.col("_west") <= F.col("_east"), F.col("lon").between(F.col("_west"), F.col("_east")))
            .otherwise((F.col("lon") >= F.col("_west")) | (F.col("lon") <= F.col("_east")))
        )
        .groupBy("id", "stap_id", *CELL)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.var_pop(difference).alias("mse"),
            F.avg(in_range.cast("double")).alias("share_in_range"),
        )
    )
    fit = F.exp(-F.expr(weight) * F.col("n") * F.col("mse") / (2 * sd * sd))
    return matched.withColumn(
        "likelihood", F.when(F.col("share_in_range") >= thr_mask, fit).otherwise(0.0)
    )


def _to_blocks(samples: DataFrame, cells: DataFrame, extents: DataFrame | None, block: float) -> DataFrame:
    """Repeat each sample for the blocks that its tag's extent touches; adds `_west` to `_north`."""
    sides = {"_west": F.min("lon"), "_east": F.max("lon"), "_south": F.min("lat"), "_north": F.max("lat")}
    whole = cells.agg(*[x.alias(name) for name, x in sides.items()]).first()
    if extents is not None:
        own = extents.select("id", *[F.col(name[1:]).cast("double").alias(name) for name in sides])
        samples = samples.join(own, "id", "left")
    bounds = {
        name: F.coalesce(F.col(name), F.lit(whole[name])) if extents is not None else F.lit(whole[name]) for name in sides
    }
    samples = samples.withColumns({name: x.cast("double") for name, x in bounds.items()})

    def blocks(low: Column, high: Column) -> Column:
        first, last = F.floor(low / block), F.floor(high / block)
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    least, most = F.lit(whole["_west"]).cast("double"), F.lit(whole["_east"]).cast("double")
    west, east = F.col("_west"), F.col("_east")
    columns = F.when(west <= east, blocks(F.greatest(west, least), F.least(east, most))).otherwise(
        F.array_union(blocks(F.greatest(west, least), most), blocks(least, F.least(east, most)))
    )
    south = F.greatest(F.col("_south"), F.lit(whole["_south"]).cast("double"))
    north = F.least(F.col("_north"), F.lit(whole["_north"]).cast("double"))
    return samples.withColumn("_lat_block", F.explode(blocks(south, north))).withColumn(
        "_lon_block", F.explode(columns)
    )


def twilights(light: DataFrame, offset_hours: float = 0, threshold: float = 0) -> DataFrame:
    """First and last light above `threshold` of each day, days starting `offset_hours` after midnight."""
    at = light.schema["ts"].dataType
    shifted = F.col("ts") - minutes(F.lit(int(offset_hours * 60)))
    lit_at = F.when(F.col("lux") > threshold, F.col("ts"))
    days = light.groupBy("id", F.to_date(shifted).alias("day")).agg(
        F.min(lit_at).alias("_rise"), F.max(lit_at).alias("_set")
    )
    events = F.array(
        F.struct(F.lit("Rise").alias("series"), F.col("_rise").cast(at).alias("timestamp")),
        F.struct(F.lit("Set").alias("series"), F.col("_set").cast(at).alias("timestamp")),
    )
    return days.select("id", "day", F.inline(events)).where(F.col("timestamp").isNotNull())


def calibration(known: DataFrame, bin_width: float = 0.5) -> DataFrame:
    """Density of the sun's zenith at twilights of known position, per bin."""
    zenith = solar_zenith(F.col("timestamp"), F.col("lat"), F.col("lon"))
    bins = known.groupBy(F.bround(zenith / bin_width, 0).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    whole = bins.agg(F.sum("_n").alias("total")).scalar()
    return bins.withColumn("density", F.col("_n") / (whole * bin_width)).drop("_n")


def light_map(
    twilight_rows: DataFrame,
    cells: DataFrame,
    calib: DataFrame,
    bin_width: float = 0.5,
    floor: float = 1e-4,
    weight: str = "ln(n)/n",
) -> DataFrame:
    """Pooled likelihood of all twilights of a stationary period in every cell of the tag's grid.

    Zeniths outside the calibration get the density `floor`.
    """
    zenith = solar_zenith(F.col("timestamp"), F.col("lat"), F.col("lon"))
    tested = twilight_rows.select("id", "stap_id", "timestamp").join(cells, "id")
    tested = tested.withColumn("bin", F.bround(zenith / bin_width, 0).cast("int"))
    density = F.greatest(F.coalesce(F.col("density"), F.lit(floor)), F.lit(floor))
    return (
        tested.join(calib, "bin", "left")
        .groupBy("id", "stap_id", *CELL)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.log(density)).alias("log_density"))
        .withColumn("likelihood", F.exp(F.expr(weight) * F.col("log_density")))
    )


def prune_cells(cells: DataFrame, mass: float = 0.9) -> DataFrame:
    """The most likely cells that together hold `mass` of each stationary period's likelihood."""
    period = Window.partitionBy("id", "stap_id")
    ranked = period.orderBy(F.col("likelihood").desc(), *CELL)
    before = F.coalesce(
        F.sum("likelihood").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    return (
        cells.withColumn("_total", F.sum("likelihood").over(period))
        .withColumn("_before", before)
        .where((F.col("likelihood") > 0) & (F.col("_before") < mass * F.col("_total")))
        .drop("_total", "_before")
    )


def normalise(cells: DataFrame) -> DataFrame:
    """Scale the likelihood of each stationary period to a sum of one."""
    total = F.sum("likelihood").over(Window.partitionBy("id", "stap_id"))
    return cells.withColumn("likelihood", F.try_divide("likelihood", total))


def combine_maps(first: DataFrame, second: DataFrame) -> DataFrame:
    """Product of two maps over their shared cells, normalised."""
    keys = ["id", "stap_id", *CELL]
    other = second.select(*keys, F.col("likelihood").alias("_other"))
    product = (
        first.select(*keys, "likelihood")
        .join(other, keys)
        .withColumn("likelihood", F.col("likelihood") * F.col("_other"))
        .drop("_other")
    )
    return normalise(product)


def refresh_map(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Replace the stationary periods listed in `changed` by their rows in `new`."""
    keys = ["id", "stap_id"]
    changed = changed.select(*keys).distinct()
    return old.join(changed, keys, "left_anti").unionByName(new.join(changed, keys, "left_semi"))


def pin_known(stap_rows: DataFrame, known: DataFrame) -> DataFrame:
    """Attach known positions to stationary periods; number -1 means the tag's last one.

    `known` has ``id, stap_ids`` (array)``, known_lat, known_lon``.
    """
    last = stap_rows.groupBy("id").agg(F.max("stap_id").alias("_last"))
    pins = (
        known.withColumn("stap_id", F.explode("stap_ids"))
        .join(last, "id")
        .withColumn(
            "stap_id", F.when(F.col("stap_id") == -1, F.col("_last")).otherwise(F.col("stap_id"))
        )
        .select("id", "stap_id", "known_lat", "known_lon")
        .distinct()
    )
    return stap_rows.join(pins, ["id", "stap_id"], "left")


def pin_map(cells: DataFrame, pinned: DataFrame, scale: float) -> DataFrame:
    """Give all likelihood of a known stationary period to the cell that holds its position."""
    known = pinned.where(F.col("known_lat").isNotNull()).select(
        "id", "stap_id", "known_lat", "known_lon"
    )
    half = 0.5 / scale
    near = (F.abs(F.col("lat") - F.col("known_lat")) <= half) & (
        F.abs(F.col("lon") - F.col("known_lon")) <= half
    )
    return (
        cells.join(known, ["id", "stap_id"], "left")
        .withColumn(
            "likelihood",
            F.when(F.col("known_lat").isNull(), F.col("likelihood")).otherwise(near.cast("double")),
        )
        .drop("known_lat", "known_lon")
    )


def map_to_path(cells: DataFrame, stap_rows: DataFrame | None = None) -> DataFrame:
    """Most likely cell of each stationary period.

    With `stap_rows` every period is listed, and those without a map lie on the
    line between the nearest mapped ones, in proportion to their mid-times.
    """
    best = cells.groupBy("id", "stap_id").agg(
        F.max_by(F.struct(*CELL), F.struct("likelihood", *CELL)).alias("_best")
    )
    best = best.select("id", "stap_id", "_best.lat", "_best.lon")
    if stap_rows is None:
        return best
    mid = (F.unix_micros(F.col("start").cast("timestamp")) + F.unix_micros(F.col("end").cast("timestamp"))) / 2
    rows = stap_rows.select("id", "stap_id", mid.alias("_mid")).join(best, ["id", "stap_id"], "left")
    spot = F.when(F.col("lat").isNotNull(), F.struct("_mid", *CELL))

    def nearest(order: Column) -> Column:
        w = Window.partitionBy("id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return F.last(spot, ignorenulls=True).over(w)

    rows = rows.withColumns(
        {"_a": nearest(F.col("stap_id").asc()), "_b": nearest(F.col("stap_id").desc())}
    )
    part = F.coalesce(
        F.try_divide(F.col("_mid") - F.col("_a._mid"), F.col("_b._mid") - F.col("_a._mid")), F.lit(0.0)
    )

    def between(c: str) -> Column:
        a, b = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        return F.coalesce(F.col(c), a + (b - a) * part, a, b)

    return rows.select(
        "id",
        "stap_id",
        between("lat").alias("lat"),
        between("lon").alias("lon"),
        F.col("lat").isNull().alias("interpolated"),
    )


def pressure_path(path: DataFrame, pressure: DataFrame, reanalysis: DataFrame) -> DataFrame:
    """Surface pressure along a path of cells, and the altitude the tag's own pressure means there."""
    rows = pressure.join(path, ["id", "stap_id"]).withColumnRenamed("date", "ts")
    rows = rows.join(reanalysis, ["ts", *CELL], "left")
    ratio = F.pow(F.col("surface_pressure") / F.col("pressure_hpa"), F.lit(EXPONENT)) - 1
    return rows.withColumn(
        "tag_altitude", F.col("altitude") + F.col("temperature_2m") / LAPSE_RATE * ratio
    ).withColumn("pressure_diff", F.col("pressure_hpa") - F.col("surface_pressure"))


def residual_hist(path_pressure: DataFrame, bin_width: float = 1.0) -> DataFrame:
    """Histogram of pressure differences per stationary period."""
    return (
        path_pressure.where(F.col("pressure_diff").isNotNull())
        .groupBy(
            "id",
            "stap_id",
            (F.bround(F.col("pressure_diff") / bin_width, 0) * bin_width).alias("bin"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )


def path_twilight(path: DataFrame, sun_altitude: float = -0.833) -> DataFrame:
    """Expected sunrise and sunset of each day and position; NULL where the sun stays up or down."""
    noon = F.col("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(12))
    declination, equation = sun_declination_and_time(noon)
    lat, dec = F.radians("lat"), F.radians(declination)
    cosine = (F.sin(F.radians(F.lit(sun_altitude))) - F.sin(lat) * F.sin(dec)) / (
        F.cos(lat) * F.cos(dec)
    )
    half_day = F.when(F.abs(cosine) <= 1, F.degrees(F.acos(cosine)) * 4)
    solar_noon = 720 - F.col("lon") * 4 - equation
    start = F.col("date").cast("timestamp_ntz")

    def at(minute: Column) -> Column:
        seconds = F.round(minute * 60).cast("decimal(18,6)")
        return (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)).cast("timestamp_ntz")

    return path.withColumns(
        {"sunrise": at(solar_noon - half_day), "sunset": at(solar_noon + half_day)}
    )
