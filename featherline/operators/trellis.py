"""Movement between the cells of consecutive stationary periods.

Nodes are cells (``id, stap_id, lat, lon, likelihood``), edges lead from the cells of one
kept period, one that has a likely cell, to the reachable cells of the tag's next one.
The edges of a stage are a matrix.  Paths and marginal maps multiply the matrices of
neighbouring stages, then of neighbouring pairs and so on, for all tags at once, and then
go back down: the number of jobs grows with the logarithm of the number of periods.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featherline.functions.geo import haversine_km
from featherline.operators.grid import normalise
from featherline.session import keep

KM_PER_DEGREE = 111.19
NO_CELL, NO_HOURS, NO_CHAIN = "no likely cell", "unknown flight hours", "no chain of reachable cells"


def kept_periods(cells: DataFrame, flights: DataFrame) -> DataFrame:
    """Periods with a likely cell: id, stap_id, stage (1, 2, ... per tag), next_stap, flight_hours.

    `flight_hours` adds up all flights from the period to the next kept one, over periods
    that are not kept; it is NULL where one of them is unknown or none is given.
    """
    kept = cells.where(F.col("likelihood") > 0).select("id", "stap_id").distinct()
    hours = flights.select("id", "stap_id", F.col("flight_hours").cast("double").alias("flight_hours"))
    none = F.lit(None).cast("double")
    marks = kept.select("id", "stap_id", none.alias("flight_hours"), F.lit(1).alias("_kept")).unionByName(
        hours.withColumn("_kept", F.lit(0))
    )
    so_far = Window.partitionBy("id").orderBy("stap_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    is_flight = F.col("_kept") == 0
    stages = (
        marks.withColumn("stage", F.sum("_kept").over(so_far))
        .where(F.col("stage") > 0)
        .groupBy("id", "stage")
        .agg(
            F.max(F.when(~is_flight, F.col("stap_id"))).alias("stap_id"),
            F.sum("flight_hours").alias("_hours"),
            F.count(F.when(is_flight, F.lit(1))).alias("_flights"),
            F.count("flight_hours").alias("_known"),
        )
    )
    return stages.select(
        "id",
        "stap_id",
        F.col("stage").cast("int").alias("stage"),
        F.lead("stap_id").over(Window.partitionBy("id").orderBy("stage")).alias("next_stap"),
        F.when((F.col("_flights") > 0) & (F.col("_flights") == F.col("_known")), F.col("_hours")).alias("flight_hours"),
    )


def _lon_tiles(band: Column, width: Column) -> Column:
    """Into how many tiles a latitude band is cut, each as wide as any reach that touches it.

    A reach of `width` degrees between latitudes of at most m spans 2*asin(sin(w/2)/cos(m))
    degrees of longitude; a band that it can pass a pole from is one tile.
    """
    far = F.greatest(F.abs((band - 1) * width), F.abs((band + 2) * width))
    half = F.sin(F.radians(F.least(width, F.lit(180.0)) / 2)) / F.cos(F.radians(F.least(far, F.lit(90.0))))
    span = F.degrees(2 * F.asin(F.least(half, F.lit(1.0))))
    return F.when((far >= 90) | (half >= 1), F.lit(1)).otherwise(F.greatest(F.floor(360 / span), F.lit(1)).cast("int"))


def _tile(lon: Column, tiles: Column) -> Column:
    return F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) * tiles / 360).cast("int"), tiles - 1)


def edges(cells: DataFrame, flights: DataFrame, max_speed: float = 150) -> DataFrame:
    """Pairs of cells a tag could have flown between at `max_speed` km/h.

    `flights` has ``id, stap_id, flight_hours`` for the flight after each period; between
    kept periods its hours are summed.  `stap_id` is the earlier period, `next_stap` the
    later one.  Cells meet within tiles of the sphere as wide as the reach: three latitude
    bands of three longitudes, around the date line, and all longitudes near a pole.
    """
    reach = F.col("flight_hours") * max_speed
    width = F.greatest(reach / KM_PER_DEGREE, F.lit(0.01))
    hops = (
        kept_periods(cells, flights)
        .where(F.col("next_stap").isNotNull() & F.col("flight_hours").isNotNull())
        .select("id", "stap_id", "next_stap", "flight_hours", width.alias("_width"))
    )
    likely = cells.where(F.col("likelihood") > 0)
    tiles = _lon_tiles(F.col("_band"), F.col("_width"))
    near = F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.pmod(_tile(F.col("lon1"), F.col("_tiles")) + k, F.col("_tiles"))))
    source = (
        likely.select("id", "stap_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
        .join(hops, ["id", "stap_id"])
        .withColumn("_band", F.floor(F.col("lat1") / F.col("_width")))
        .withColumn("_band", F.explode(F.sequence(F.col("_band") - 1, F.col("_band") + 1)))
        .withColumn("_tiles", tiles)
        .withColumn("_tile", F.explode(near))
        .drop("_tiles", "_width")
    )
    target = (
        likely.select("id", F.col("stap_id").alias("next_stap"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
        .join(hops.select("id", "stap_id", "next_stap", "_width"), ["id", "next_stap"])
        .withColumn("_band", F.floor(F.col("lat2") / F.col("_width")))
        .withColumn("_tile", _tile(F.col("lon2"), tiles))
        .drop("_width", "next_stap")
    )
    distance = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    speed = F.when(F.col("distance_km") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("distance_km"), F.col("flight_hours")))
    return (
        source.join(target, ["id", "stap_id", "_band", "_tile"])
        .withColumn("distance_km", distance)
        .where(F.col("distance_km") <= F.col("flight_hours") * max_speed)
        .withColumn("speed", speed)
        .select("id", "stap_id", "next_stap", "lat1", "lon1", "lat2", "lon2", "distance_km", "speed")
    )


def edge_weight(
    edge_rows: DataFrame,
    shape: float = 6,
    scale: float = 7,
    low_speed: float = 20,
    zero_ratio: float = 1.5,
) -> DataFrame:
    """Gamma density of the ground speed.

    Speeds below `low_speed` count as `low_speed`; staying put counts
    `zero_ratio` times as much.
    """
    speed = F.greatest(F.col("speed"), F.lit(float(low_speed)))
    norm = math.gamma(shape) * scale**shape
    density = F.pow(speed, F.lit(shape - 1.0)) * F.exp(-speed / scale) / norm
    return edge_rows.withColumn(
        "weight", F.when(F.col("speed") == 0, density * zero_ratio).otherwise(density)
    )


CELL_A, CELL_B = ["lat1", "lon1"], ["lat2", "lon2"]


class _Trellis:
    """The kept nodes of all tags, and the products of their stages' matrices.

    A matrix is rows of (id, block, from cell, to cell, value): block b of level k stands
    for the edges b*2^k to (b+1)*2^k-1 of a tag, which has `n_edges` of them.  The value
    takes in the likelihood of the cell it leads to.
    """

    def __init__(self, cells: DataFrame, weighted: DataFrame, logs: bool) -> None:
        likely = cells.where(F.col("likelihood") > 0).select("id", "stap_id", "lat", "lon", F.col("likelihood").cast("double").alias("likelihood"))
        stages = likely.select("id", "stap_id").distinct()
        per_tag = Window.partitionBy("id")
        stages = stages.select(
            "id",
            "stap_id",
            (F.row_number().over(per_tag.orderBy("stap_id")) - 1).alias("stage"),
            (F.count("*").over(per_tag) - 1).cast("int").alias("n_edges"),
        )
        self.logs = logs
        self.nodes = keep(likely.join(stages, ["id", "stap_id"]))
        self.height = max(0, ((self.nodes.agg(F.max("n_edges")).first()[0] or 0) - 1)).bit_length()
        value = F.log("weight") + F.log("likelihood") if logs else F.col("weight") * F.col("likelihood")
        into = self.nodes.select("id", F.col("stage").alias("_to"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "likelihood", "n_edges")
        first = (
            weighted.where(F.col("weight") > 0)
            .select("id", "stap_id", *CELL_A, *CELL_B, "weight")
            .join(stages.select("id", "stap_id", "stage"), ["id", "stap_id"])
            .withColumn("_to", F.col("stage") + 1)
            .join(into, ["id", "_to", *CELL_B])
            .select("id", F.col("stage").alias("block"), "n_edges", *CELL_A, *CELL_B, value.alias("value"))
        )
        self.levels = [keep(first)]
        for k in range(self.height):
            self.levels.append(keep(self._next(k)))

    def level(self, k: int) -> DataFrame:
        """The matrices of a level; sums are scaled to a maximum of one, so long tracks stay in range."""
        found = self.levels[k]
        if self.logs:
            return found
        top = found.groupBy("id", "block").agg(F.max("value").alias("_top"))
        return found.join(top, ["id", "block"]).withColumn("value", F.col("value") / F.col("_top")).drop("_top")

    def halves(self, parents: DataFrame, k: int) -> DataFrame:
        """Whether each block of level k+1 has two blocks of level k, as `_two`."""
        last = F.shiftright(F.col("n_edges") - 1, k)
        return parents.withColumn("_two", 2 * F.col("block") + 1 <= last)

    def _next(self, k: int) -> DataFrame:
        here = self.level(k).withColumn("_half", F.col("block") % 2).withColumn("block", F.shiftright("block", 1))
        here = self.halves(here, k)
        left = here.where((F.col("_half") == 0) & F.col("_two")).select("id", "block", "n_edges", *CELL_A, F.col("lat2").alias("_lat"), F.col("lon2").alias("_lon"), "value")
        right = here.where(F.col("_half") == 1).select("id", "block", F.col("lat1").alias("_lat"), F.col("lon1").alias("_lon"), *CELL_B, F.col("value").alias("_value"))
        keys = ["id", "block", "n_edges", *CELL_A, *CELL_B]
        total = F.max(F.col("value") + F.col("_value")) if self.logs else F.sum(F.col("value") * F.col("_value"))
        products = left.join(right, ["id", "block", "_lat", "_lon"]).groupBy(*keys).agg(total.alias("value"))
        return products.unionByName(here.where(~F.col("_two")).select(*keys, "value"))


def _with_reasons(found: DataFrame, columns: list[str], cells: DataFrame, flights: DataFrame | None) -> DataFrame:
    """Every tag of the cells, and of the flights, has rows: those found, or one with the reason why there are none."""
    tags = cells.select("id").distinct()
    likely = cells.where(F.col("likelihood") > 0).select("id").distinct().withColumn("_likely", F.lit(True))
    why = tags.join(likely, "id", "left").withColumn("_unknown", F.lit(None).cast("boolean"))
    if flights is not None:
        unknown = kept_periods(cells, flights).where(F.col("next_stap").isNotNull() & F.col("flight_hours").isNull())
        tags = tags.unionByName(flights.select("id")).distinct()
        why = tags.join(likely, "id", "left").join(unknown.select("id").distinct().withColumn("_unknown", F.lit(True)), "id", "left")
    why = why.select("id", F.when(F.col("_likely").isNull(), F.lit(NO_CELL)).when(F.col("_unknown"), F.lit(NO_HOURS)).otherwise(F.lit(NO_CHAIN)).alias("reason"))
    kinds = dict(found.dtypes)
    missing = why.join(found.select("id").distinct(), "id", "left_anti")
    rows = missing.select("id", *(F.lit(None).cast(kinds[c]).alias(c) for c in columns), "reason")
    return found.select("id", *columns, F.lit(None).cast("string").alias("reason")).unionByName(rows)


def most_likely(cells: DataFrame, weighted: DataFrame, flights: DataFrame | None = None) -> DataFrame:
    """The path of greatest product of map likelihood and edge weight per tag.

    Returns ``id, stap_id, lat, lon, score, reason``: a row for each kept period, with the
    logarithm of the whole path's product, or one row with the reason where a tag has no
    path.  Ties go to the end, start and middle cells of greater latitude, then longitude.
    """
    trellis = _Trellis(cells, weighted, logs=True)
    nodes, cell = trellis.nodes, ["lat", "lon"]
    own = F.log("likelihood")
    alone = (
        nodes.where(F.col("n_edges") == 0)
        .groupBy("id", "stap_id")
        .agg(F.max(F.struct(own.alias("score"), *cell)).alias("_b"))
        .select("id", "stap_id", "_b.lat", "_b.lon", "_b.score")
    )
    starts = nodes.where("stage = 0").select("id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), own.alias("_own"))
    best = (
        trellis.levels[-1]
        .join(starts, ["id", *CELL_A])
        .groupBy("id", "block", "n_edges")
        .agg(F.max(F.struct((F.col("value") + F.col("_own")).alias("score"), *CELL_B, *CELL_A)).alias("_b"))
    )
    points = keep(best.select("id", "block", "n_edges", *(f"_b.{c}" for c in [*CELL_A, *CELL_B, "score"])))
    for k in reversed(range(trellis.height)):
        parents = trellis.halves(points, k)
        halves = trellis.levels[k].withColumn("_half", F.col("block") % 2).withColumn("block", F.shiftright("block", 1))
        left = halves.where("_half = 0").select("id", "block", *CELL_A, F.col("lat2").alias("_lat"), F.col("lon2").alias("_lon"), "value")
        right = halves.where("_half = 1").select("id", "block", F.col("lat1").alias("_lat"), F.col("lon1").alias("_lon"), *CELL_B, F.col("value").alias("_value"))
        middle = (
            parents.where("_two")
            .join(left, ["id", "block", *CELL_A])
            .join(right, ["id", "block", "_lat", "_lon", *CELL_B])
            .groupBy("id", "block", "n_edges", *CELL_A, *CELL_B, "score")
            .agg(F.max(F.struct((F.col("value") + F.col("_value")).alias("v"), "_lat", "_lon")).alias("_m"))
        )
        a, m, b = (F.struct(F.col(x).alias("lat"), F.col(y).alias("lon")) for x, y in (CELL_A, ("_m._lat", "_m._lon"), CELL_B))
        first = F.struct((2 * F.col("block")).alias("block"), a.alias("a"), m.alias("b"))
        second = F.struct((2 * F.col("block") + 1).alias("block"), m.alias("a"), b.alias("b"))
        cut = middle.select("id", "n_edges", "score", F.explode(F.array(first, second)).alias("x")).select(
            "id", "x.block", "n_edges", *(F.col(f"x.{side}.{c}").alias(f"{c}{n}") for side, n in (("a", 1), ("b", 2)) for c in cell), "score"
        )
        whole = parents.where("NOT _two").drop("_two").withColumn("block", 2 * F.col("block"))
        points = keep(cut.unionByName(whole.select(cut.columns)))
    ends = points.where(F.col("block") == F.col("n_edges") - 1)
    steps = points.select("id", F.col("block").alias("stage"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon"), "score").unionByName(
        ends.select("id", F.col("n_edges").alias("stage"), F.col("lat2").alias("lat"), F.col("lon2").alias("lon"), "score")
    )
    path = steps.join(nodes.select("id", "stage", "stap_id").distinct(), ["id", "stage"]).select("id", "stap_id", *cell, "score")
    return _with_reasons(path.unionByName(alone), ["stap_id", *cell, "score"], cells, flights)


def marginal(cells: DataFrame, weighted: DataFrame, flights: DataFrame | None = None) -> DataFrame:
    """Probability of every cell given the whole track, one per period and tag.

    Returns ``id, stap_id, lat, lon, likelihood, reason``: the cells that some path goes
    through, or one row with the reason where a tag has no path.
    """
    trellis = _Trellis(cells, weighted, logs=False)
    nodes = trellis.nodes
    keys = ["id", "stap_id", "lat", "lon", "likelihood"]
    chained = nodes.where(F.col("n_edges") > 0)
    ahead = chained.where("stage = 0").select("id", F.lit(0).alias("block"), "n_edges", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("likelihood").alias("_ahead"))
    back = chained.where(F.col("stage") == F.col("n_edges")).select("id", F.lit(0).alias("block"), "n_edges", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.lit(1.0).alias("_back"))

    def passed(parents: DataFrame, k: int, side: int, mine: list[str], other: list[str], name: str) -> DataFrame:
        """Take vectors at one side of blocks of level k+1 to the same side of their halves.

        One half has the block's own vector; the vector of the half beyond goes through
        the matrix of the half between.
        """
        parents = trellis.halves(parents, k)
        between = trellis.level(k).where(F.col("block") % 2 == side).withColumn("block", F.shiftright("block", 1))
        through = (
            parents.where("_two")
            .join(between.select("id", "block", *CELL_A, *CELL_B, "value"), ["id", "block", *mine])
            .groupBy("id", (2 * F.col("block") + 1 - side).alias("block"), "n_edges", *(F.col(o).alias(m) for m, o in zip(mine, other)))
            .agg(F.sum(F.col(name) * F.col("value")).alias(name))
        )
        same = parents.withColumn("block", 2 * F.col("block") + F.when(F.col("_two"), F.lit(side)).otherwise(F.lit(0))).drop("_two")
        return keep(through.unionByName(same.select(through.columns)))

    for k in reversed(range(trellis.height)):
        ahead = passed(ahead, k, 0, CELL_A, CELL_B, "_ahead")
        back = passed(back, k, 1, CELL_B, CELL_A, "_back")
    through = keep(
        trellis.level(0)
        .join(ahead.drop("n_edges"), ["id", "block", *CELL_A])
        .join(back.drop("n_edges"), ["id", "block", *CELL_B])
        .withColumn("likelihood", F.col("_ahead") * F.col("value") * F.col("_back"))
    )
    before = through.groupBy("id", F.col("block").alias("stage"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon")).agg(F.sum("likelihood").alias("likelihood"))
    ends = through.where(F.col("block") == F.col("n_edges") - 1)
    after = ends.groupBy("id", F.col("n_edges").alias("stage"), F.col("lat2").alias("lat"), F.col("lon2").alias("lon")).agg(F.sum("likelihood").alias("likelihood"))
    summed = before.unionByName(after).join(nodes.select("id", "stage", "stap_id").distinct(), ["id", "stage"])
    alone = nodes.where(F.col("n_edges") == 0).select(keys)
    found = normalise(summed.select(keys).unionByName(alone))
    return _with_reasons(found, keys[1:], cells, flights)
