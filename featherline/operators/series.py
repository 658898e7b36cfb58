"""Window steps over a long series per tag that survive one very large tag.

A plain window over ``id`` sorts a whole tag in one task.  `split_hot` looks at
the row count per tag; tags beyond the limit are cut into consecutive segments
of about `limit` rows at splitters taken from a sorted sample of their rows, and
the helpers below run inside a segment, then carry the few values that cross a
segment border.  Splitters are pairs of time and row key, a hash of the whole
row, so a burst of rows at one instant is cut as well; only rows equal in all
columns stay together.  Inside a split table rows of one time stand in the order
of their row keys.  With no large tag the table is returned as it is and every
helper is an ordinary window over ``id``.

The tables used for carrying have a proven size: fewer than `MAX_HOT` tags can
hold more than one part in `MAX_HOT` of all rows, and their splitters are a fixed
multiple of that number.  They are the only ones broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from featherline.session import keep

SEGMENT = "_segment"
ROW = "_row_key"
MAX_ROWS = 5_000_000
MAX_HOT = 10_000
SAMPLES_PER_SEGMENT = 64
CUTS_PER_TOP = 100


def split_hot(
    df: DataFrame, key: str = "id", order: str = "date", max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Add a segment number to the rows of tags with more than `max_rows` rows; None skips the check.

    Runs one counting job over `key` and `order` only.  Rows of other tags get
    a NULL segment; when there is no large tag the column is not added.
    """
    if max_rows is None or SEGMENT in df.columns:
        return df
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    size = counts.agg(F.sum("_n").alias("rows"), F.max("_n").alias("largest")).first()
    if size.rows is None or size.largest <= max_rows:
        return df
    limit = max(max_rows, size.rows // MAX_HOT)
    hot = keep(counts.where(F.col("_n") > limit).select(key))
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, MapType)]
    keyed = df.withColumn(ROW, F.xxhash64(*hashed))
    at = F.struct(F.col(order).alias("at"), F.col(ROW).alias("row"))
    cuts = keep(_splitters(keyed.join(F.broadcast(hot), key).select(key, at.alias("_at")), key, limit))
    # Two levels, so that a row is compared with a few splitters of a very large tag only.
    tops = F.size(F.filter("_tops", lambda cut: cut <= at))
    below = F.slice("_cuts", F.greatest(tops - 1, F.lit(0)) * CUTS_PER_TOP + 1, CUTS_PER_TOP)
    segment = F.greatest(tops - 1, F.lit(0)) * CUTS_PER_TOP + F.size(F.filter(below, lambda cut: cut <= at))
    return (
        keyed.join(F.broadcast(cuts), key, "left")
        .withColumn(SEGMENT, F.when(F.col("_cuts").isNotNull(), segment))
        .drop("_cuts", "_tops")
    )


def _splitters(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """For each tag the sorted places `_at` that begin a segment, and every `CUTS_PER_TOP`th of them.

    The sample has about `SAMPLES_PER_SEGMENT` rows for `limit` rows, and is all rows below that limit.
    """
    step = min(SAMPLES_PER_SEGMENT, limit)
    sample = keep(rows if step == limit else rows.where(F.rand(11) < step / limit))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_at"))
    cuts = sample.withColumn("_nth", nth).where(F.col("_nth") % step == 0)
    cuts = cuts.groupBy(key).agg(F.sort_array(F.collect_set("_at")).alias("_cuts"))
    return cuts.withColumn("_tops", F.filter("_cuts", lambda cut, i: i % CUTS_PER_TOP == 0))


def without_segments(df: DataFrame) -> DataFrame:
    return df.drop(SEGMENT, ROW)


def _within(df: DataFrame, key: str):
    return Window.partitionBy(key, SEGMENT) if SEGMENT in df.columns else Window.partitionBy(key)


def _order(df: DataFrame, order: str) -> list[str]:
    return [order, ROW] if ROW in df.columns else [order]


def _place(df: DataFrame, order: str) -> Column:
    """A value that orders the rows of a split table as `_order` does."""
    return F.struct(*_order(df, order))


def _segment_table(df: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    named = [expr.alias(name) for name, expr in aggregates.items()]
    return df.where(F.col(SEGMENT).isNotNull()).groupBy(key, SEGMENT).agg(*named)


def neighbours(
    df: DataFrame,
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    default=None,
    key: str = "id",
    order: str = "date",
) -> DataFrame:
    """Values of the previous (`before`) and next (`after`) row of the same tag."""
    before, after = before or {}, after or {}
    w = _within(df, key).orderBy(*_order(df, order))
    if SEGMENT not in df.columns:
        return df.withColumns(
            {name: F.lag(x, 1, default).over(w) for name, x in before.items()}
            | {name: F.lead(x, 1, default).over(w) for name, x in after.items()}
        )
    rank = Window.partitionBy(key).orderBy(SEGMENT)
    sides = {}
    if before:
        sides["_tail"] = F.max_by(F.struct(*[x.alias(n) for n, x in before.items()]), _place(df, order))
    if after:
        sides["_head"] = F.min_by(F.struct(*[x.alias(n) for n, x in after.items()]), _place(df, order))
    edges = _segment_table(df, key, **sides)
    if before:
        edges = edges.withColumn("_tail", F.lag("_tail").over(rank))
    if after:
        edges = edges.withColumn("_head", F.lead("_head").over(rank))
    local = df.withColumns(
        {name: F.lag(x, 1).over(w) for name, x in before.items()}
        | {name: F.lead(x, 1).over(w) for name, x in after.items()}
        | {
            "_first": F.lag(F.lit(1)).over(w).isNull(),
            "_last": F.lead(F.lit(1)).over(w).isNull(),
        }
    ).join(F.broadcast(keep(edges)), [key, SEGMENT], "left")

    def settle(name: str, at_edge: str, carried: str) -> Column:
        outside = F.when(F.col(carried).isNotNull(), F.col(f"{carried}.{name}")).otherwise(
            F.lit(default)
        )
        return F.when(F.col(at_edge), outside).otherwise(F.col(name))

    return local.withColumns(
        {name: settle(name, "_first", "_tail") for name in before}
        | {name: settle(name, "_last", "_head") for name in after}
    ).drop("_first", "_last", "_tail", "_head")


def running_sum(
    df: DataFrame, sums: dict[str, Column], key: str = "id", order: str = "date"
) -> DataFrame:
    """Running totals up to and including the current row."""
    w = _within(df, key).orderBy(*_order(df, order)).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({name: F.sum(x).over(w) for name, x in sums.items()})
    if SEGMENT not in df.columns:
        return local
    earlier = Window.partitionBy(key).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    totals = _segment_table(df, key, **{f"_add_{n}": F.sum(x) for n, x in sums.items()})
    totals = totals.withColumns({f"_add_{n}": F.sum(f"_add_{n}").over(earlier) for n in sums})
    out = local.join(F.broadcast(keep(totals)), [key, SEGMENT], "left")
    return out.withColumns(
        {n: F.col(n) + F.coalesce(F.col(f"_add_{n}"), F.lit(0)) for n in sums}
    ).drop(*[f"_add_{n}" for n in sums])


def per_key(df: DataFrame, aggregates: dict[str, Column], key: str = "id") -> DataFrame:
    """Attach aggregates over the whole tag to each of its rows."""
    if SEGMENT not in df.columns:
        w = Window.partitionBy(key)
        return df.withColumns({name: x.over(w) for name, x in aggregates.items()})
    w = _within(df, key)
    whole = (
        df.where(F.col(SEGMENT).isNotNull())
        .groupBy(key)
        .agg(*[x.alias(f"_all_{n}") for n, x in aggregates.items()])
    )
    out = df.withColumns({name: x.over(w) for name, x in aggregates.items()}).join(
        F.broadcast(keep(whole)), key, "left"
    )
    return out.withColumns(
        {
            n: F.when(F.col(SEGMENT).isNotNull(), F.col(f"_all_{n}")).otherwise(F.col(n))
            for n in aggregates
        }
    ).drop(*[f"_all_{n}" for n in aggregates])


def fill_down(
    df: DataFrame, column: str, key: str = "id", order: str = "date", out: str | None = None
) -> DataFrame:
    """Carry the last known value forward within a tag."""
    return _fill(df, column, key, order, out or column, forward=True)


def fill_up(
    df: DataFrame, column: str, key: str = "id", order: str = "date", out: str | None = None
) -> DataFrame:
    """Carry the next known value backward within a tag."""
    return _fill(df, column, key, order, out or column, forward=False)


def _fill(df: DataFrame, column: str, key: str, order: str, out: str, forward: bool) -> DataFrame:
    # A frame that reaches to the end of the series is rebuilt for every row, so
    # filling upwards walks the rows in reverse instead.
    x = F.col(column)
    along = [F.col(c).asc() if forward else F.col(c).desc() for c in _order(df, order)]
    upto = (Window.unboundedPreceding, 0)
    filled = F.last(x, ignorenulls=True).over(_within(df, key).orderBy(*along).rowsBetween(*upto))
    if SEGMENT not in df.columns:
        return df.withColumn(out, filled)
    known_at = F.when(x.isNotNull(), _place(df, order))
    nearest = F.max_by(x, known_at) if forward else F.min_by(x, known_at)
    rank = F.col(SEGMENT).asc() if forward else F.col(SEGMENT).desc()
    earlier = Window.partitionBy(key).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    edges = _segment_table(df, key, _carry=nearest)
    edges = edges.withColumn("_carry", F.last("_carry", ignorenulls=True).over(earlier))
    return (
        df.withColumn(out, filled)
        .join(F.broadcast(keep(edges)), [key, SEGMENT], "left")
        .withColumn(out, F.coalesce(F.col(out), F.col("_carry")))
        .drop("_carry")
    )


def run_id(
    df: DataFrame, column: str, out: str = "run_id", key: str = "id", order: str = "date"
) -> DataFrame:
    """Number the runs of equal neighbouring values 1, 2, ...; missing equals missing."""
    x = F.col(column)
    df = neighbours(df, {"_before": F.struct(x.alias("v"))}, key=key, order=order)
    starts = F.col("_before").isNull() | ~x.eqNullSafe(F.col("_before.v"))
    return running_sum(df, {out: F.when(starts, 1).otherwise(0)}, key, order).drop("_before")


def gap_sessions(
    df: DataFrame, gap_days: int, out: str = "session", key: str = "id", order: str = "date"
) -> DataFrame:
    """Number stretches of dates; a step of `gap_days` or more opens a new one."""
    df = neighbours(df, {"_before": F.col(order)}, key=key, order=order)
    gap = F.datediff(F.col(order), F.col("_before"))
    opens = F.when(gap.isNull() | (gap >= gap_days), 1).otherwise(0)
    return running_sum(df.withColumn("gap", gap), {out: opens}, key, order).drop("_before")


def first_where(
    df: DataFrame, conditions: dict[str, Column], key: str = "id", order: str = "date"
) -> DataFrame:
    """Per tag, the first time at which each condition holds."""
    return df.groupBy(key).agg(
        *[F.min(F.when(cond, F.col(order))).alias(name) for name, cond in conditions.items()]
    )
