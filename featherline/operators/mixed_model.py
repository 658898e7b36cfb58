"""Random-intercept model of activity on the barrier class, by restricted likelihood.

Only sums per tag are needed, and tags with the same number of days can share
them, so the data are read once.  What is left is a table with one row per
distinct group size, over which the variance ratio is searched.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featherline.session import keep


def coded(df: DataFrame, x: str, reference: str, other: str) -> DataFrame:
    """The column `x` of two levels as 0 for the reference and 1 for the other; any further level is unknown."""
    level = F.col(x)
    return df.withColumn(x, F.when(level == F.lit(reference), 0).when(level == F.lit(other), 1))


def group_sums(df: DataFrame, y: str, x: str) -> DataFrame:
    """Sums of a response and a 0/1 regressor per tag, added up by group size.

    Moments of each tag are taken around its own means and then moved to the mean of all
    rows (`shift`), so that a large mean costs no digits.
    """
    y, x = F.col(y).cast("double"), F.col(x).cast("double")
    tags = keep(
        df.where(y.isNotNull() & x.isNotNull())
        .groupBy("id")
        .agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            F.avg(x).alias("mx"),
            F.avg(y).alias("my"),
            F.var_pop(x).alias("vxx"),
            F.covar_pop(x, y).alias("vxy"),
            F.var_pop(y).alias("vyy"),
        )
    )
    shift = tags.agg(F.try_divide(F.sum(F.col("n") * F.col("my")), F.sum("n"))).first()[0]
    n, mx = F.col("n"), F.col("mx")
    apart = F.col("my") - F.lit(shift).cast("double")
    tags = tags.select(
        "n",
        (n * mx).alias("x"),
        (n * apart).alias("y"),
        (n * (F.col("vxx") + mx * mx)).alias("xx"),
        (n * (F.col("vxy") + mx * apart)).alias("xy"),
        (n * (F.col("vyy") + apart * apart)).alias("yy"),
    )
    return tags.groupBy("n").agg(
        F.lit(shift).cast("double").alias("shift"),
        F.count(F.lit(1)).cast("double").alias("m"),
        *[F.sum(c).alias(c) for c in ("x", "y", "xx", "xy", "yy")],
        F.sum(F.col("x") * F.col("x")).alias("x_x"),
        F.sum(F.col("x") * F.col("y")).alias("x_y"),
        F.sum(F.col("y") * F.col("y")).alias("y_y"),
    )


def profile(sums: DataFrame, ratios: list[float]) -> DataFrame:
    """Restricted deviance and estimates for each ratio of tag to residual variance."""
    c = F.col("ratio") / (1 + F.col("n") * F.col("ratio"))
    parts = (
        sums.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
        .groupBy("ratio")
        .agg(
            F.max("shift").alias("shift"),
            F.sum(F.col("m") * F.col("n")).alias("rows"),
            F.sum(F.col("m") * (F.col("n") - c * F.col("n") * F.col("n"))).alias("a11"),
            F.sum(F.col("x") - c * F.col("n") * F.col("x")).alias("a1x"),
            F.sum(F.col("xx") - c * F.col("x_x")).alias("axx"),
            F.sum(F.col("y") - c * F.col("n") * F.col("y")).alias("a1y"),
            F.sum(F.col("xy") - c * F.col("x_y")).alias("axy"),
            F.sum(F.col("yy") - c * F.col("y_y")).alias("ayy"),
            F.sum(F.col("m") * F.log(1 + F.col("n") * F.col("ratio"))).alias("log_v"),
        )
    )
    det = F.col("a11") * F.col("axx") - F.col("a1x") * F.col("a1x")
    solved = parts.withColumn("det", det).withColumns(
        {
            "intercept": (F.col("axx") * F.col("a1y") - F.col("a1x") * F.col("axy")) / F.col("det"),
            "slope": (F.col("a11") * F.col("axy") - F.col("a1x") * F.col("a1y")) / F.col("det"),
        }
    )
    free = F.col("rows") - 2
    rss = F.col("ayy") - F.col("intercept") * F.col("a1y") - F.col("slope") * F.col("axy")
    return (
        solved.withColumn("var_residual", rss / free)
        .withColumn(
            "deviance",
            free * (F.log("var_residual") + 1 + math.log(2 * math.pi))
            + F.col("log_v")
            + F.log("det"),
        )
        .withColumn("var_id", F.col("ratio") * F.col("var_residual"))
        .withColumns(
            {
                "se_intercept": F.sqrt(F.col("var_residual") * F.col("axx") / F.col("det")),
                "se_slope": F.sqrt(F.col("var_residual") * F.col("a11") / F.col("det")),
                "intercept": F.col("intercept") + F.col("shift"),
                "mean_reference": F.col("intercept") + F.col("shift"),
                "mean_other": F.col("intercept") + F.col("shift") + F.col("slope"),
                "se_mean_other": F.sqrt(
                    F.col("var_residual")
                    * (F.col("axx") + F.col("a11") - 2 * F.col("a1x"))
                    / F.col("det")
                ),
                "contrast": -F.col("slope"),
            }
        )
        .drop("shift", "a11", "a1x", "axx", "a1y", "axy", "ayy", "log_v", "det")
    )


def barrier_model(
    df: DataFrame, y: str, x: str, tolerance: float = 1e-7, points: int = 21, limits: tuple[float, float] = (-12.0, 12.0)
) -> DataFrame:
    """The ratio of least deviance with its estimates, as one row.

    The least deviance over zero and a logarithmic grid is bracketed by its neighbours; each
    round puts a finer grid over the bracket, or moves on if the least is at its end.
    `converged` says that the bracket is no wider than the tolerance, in powers of ten of the ratio, or that
    the least is at zero and no ratio down to the lower limit is as good.  A search that ends at the
    upper limit has not converged.  Without rows the table is empty.  The driver sees a few
    numbers per round.
    """
    sums = keep(group_sums(df, y, x))
    low, high = max(-6.0, limits[0]), min(4.0, limits[1])
    while True:
        step = (high - low) / (points - 1)
        powers = [low + step * i for i in range(points)]
        ratios = [0.0, *(10.0**p for p in powers)]
        best = profile(sums, ratios).where("deviance is not null").orderBy("deviance", "ratio").limit(1)
        row = best.first()
        if row is None:
            return best.withColumn("converged", F.lit(False))
        at = ratios.index(row.ratio) - 1
        if at < 0:
            if low <= limits[0]:
                return best.withColumn("converged", F.lit(True))
            low, high = max(limits[0], low - 4.0), low + step
        elif at == points - 1 and high < limits[1]:
            low, high = high - step, min(limits[1], high + 4.0)
        elif at == 0 and low > limits[0]:
            low, high = max(limits[0], low - 4.0 * step), low + step
        elif step <= tolerance:
            return best.withColumn("converged", F.lit(at < points - 1))
        else:
            low, high = max(limits[0], powers[at] - step), min(limits[1], powers[at] + step)
