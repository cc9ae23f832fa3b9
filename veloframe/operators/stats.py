"""Shares, top-n, bins, densities and small models."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles


def share(df: DataFrame, by: Sequence[str], weight: str, within: Sequence[str] = ()) -> DataFrame:
    """Sum of ``weight`` by ``by`` and its percentage of the total (of ``within``)."""
    sums = df.groupBy(*by).agg(F.sum(weight).alias("sum"))
    if within:
        total = F.sum("sum").over(Window.partitionBy(*within))
    else:
        total = sums.agg(F.sum("sum")).scalar()
    return sums.withColumn("prop", F.col("sum") / total * F.lit(100.0))


def weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str]) -> DataFrame:
    """Sum(value * weight) / sum(weight); rows without a value still count in the
    denominator."""
    return df.groupBy(*by).agg(
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("wtd_mean"))


def ranked(df: DataFrame, values: Sequence[str], ties: Sequence[str] = (),
           ascending: bool = False) -> DataFrame:
    """Sort by ``values``, then by ``ties``; the tie columns also let the range
    partitioning split a value that many rows share."""
    order = [F.col(c).asc() if ascending else F.col(c).desc() for c in values]
    return df.orderBy(*order, *[F.col(c).asc() for c in ties])


def top_n(df: DataFrame, n: int, value: str, within: Sequence[str] = ()) -> DataFrame:
    """The n largest by ``value``, ties kept, overall or in each group."""
    if within:
        w = Window.partitionBy(*within).orderBy(F.col(value).desc())
        return df.withColumn("_rank", F.rank().over(w)).where(F.col("_rank") <= n).drop("_rank")
    floor = df.orderBy(F.col(value).desc_nulls_last()).limit(n).agg(F.min(value))
    return df.where(F.col(value) >= floor.scalar())


def head_rows(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def min_support(df: DataFrame, k: float, count: str = "count") -> DataFrame:
    return df.where(F.col(count) >= k)


def minmax(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def category_count(df: DataFrame, flag: str) -> DataFrame:
    return df.groupBy(flag).agg(F.count("*").alias("n"))


def quantile_breaks(df: DataFrame, value: str, k: int, method: str = "distributed") -> DataFrame:
    """The k + 1 edges that cut ``value`` into k equally filled parts."""
    return quantiles(df, value, [i / k for i in range(k + 1)], method=method)


def with_break_labels(df: DataFrame, value: str, breaks: Sequence[float]) -> DataFrame:
    from ..functions.buckets import cut_between_extremes
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    return df.withColumn("_e", ends).withColumn("brks", cut_between_extremes(
        F.col(value).cast("double"), breaks,
        F.col("_e.lo").cast("double"), F.col("_e.hi").cast("double"))).drop("_e")


def histogram(df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts over the data's range; the last bin is closed on top."""
    ends = df.agg(F.expr(f"""struct(cast(min(`{value}`) as double) as lo,
        (max(`{value}`) - min(`{value}`)) / {bins}D as width)""")).scalar()
    return (df.where(F.col(value).isNotNull())
            .select(*by, F.col(value).cast("double").alias("_v"), ends.alias("_e"))
            .selectExpr(*[f"`{c}`" for c in by], "_e", f"""cast(case when _e.width > 0 then
                least(floor((_v - _e.lo) / _e.width), {bins - 1}) else 0 end as int) as bin""")
            .groupBy(*by, "bin").agg(F.count("*").alias("count")).withColumn("_e", ends)
            .withColumn("bin_start", F.expr("_e.lo + bin * _e.width")).drop("_e"))


def hexbin(df: DataFrame, x: str, y: str, bins: int = 30, by: Sequence[str] = (),
           log_x: bool = False, log_y: bool = False) -> DataFrame:
    """Counts on a hexagonal lattice, ``bins`` cells across each axis.

    Centres form two interleaved rectangular lattices, one shifted by half a
    cell; a point belongs to the nearer of its two candidates.
    """
    def axis(c: str, log: bool) -> str:
        return f"log10(cast(`{c}` as double))" if log else f"cast(`{c}` as double)"

    by_sql = [f"`{c}`" for c in by]
    pts = (df.selectExpr(*by_sql, f"{axis(x, log_x)} as _x", f"{axis(y, log_y)} as _y")
           .where("_x is not null and _y is not null"))
    facts = pts.agg(F.expr(f"""struct(min(_x) as x0, min(_y) as y0, (max(_x) - min(_x)) / {bins}D as wx,
        (max(_y) - min(_y)) / {bins}D * sqrt(3D) as wy)""")).scalar()
    return (pts.withColumn("_f", facts)
            .selectExpr(*by_sql, "_f", "coalesce(try_divide(_x - _f.x0, _f.wx), 0D) as _u",
                        "coalesce(try_divide(_y - _f.y0, _f.wy), 0D) as _w")
            .selectExpr("*", "cast(floor(_u + 0.5D) as double) as _au", "cast(floor(_w + 0.5D) as double) as _aw",
                        "floor(_u) + 0.5D as _bu", "floor(_w) + 0.5D as _bw")
            .selectExpr("*", """(_u - _au) * (_u - _au) + 3D * (_w - _aw) * (_w - _aw)
                <= (_u - _bu) * (_u - _bu) + 3D * (_w - _bw) * (_w - _bw) as _first""")
            .selectExpr(*by_sql, "_f", "if(_first, _au, _bu) as hex_u", "if(_first, _aw, _bw) as hex_w")
            .groupBy(*by, "hex_u", "hex_w").agg(F.count("*").alias("count")).withColumn("_f", facts)
            .selectExpr(*by_sql, "hex_u", "hex_w", "count", "_f.x0 + hex_u * _f.wx as center_x",
                        "_f.y0 + hex_w * _f.wy as center_y"))


def _facts(df: DataFrame, x: str, y: str, weight: str | None = None) -> Column:
    """Extent, deviations, count and total weight of the points, in one scan, as
    a scalar struct."""
    return df.agg(F.expr(f"""struct(
        cast(min(`{x}`) as double) as x0, cast(max(`{x}`) as double) as x1,
        cast(min(`{y}`) as double) as y0, cast(max(`{y}`) as double) as y1,
        stddev_samp(`{x}`) as sx, stddev_samp(`{y}`) as sy, cast(count(*) as double) as n,
        cast({f"sum(`{weight}`)" if weight else "count(*)"} as double) as total)""")).scalar()


def grid(df: DataFrame, x: str, y: str, n: int = 25) -> DataFrame:
    """An n x n grid of points over the extent of the data."""
    return (df.sparkSession.range(1).selectExpr(f"explode(sequence(0, {n - 1})) as gi")
            .selectExpr("gi", f"explode(sequence(0, {n - 1})) as gj")
            .withColumn("_f", _facts(df, x, y))
            .selectExpr("gi", "gj", f"_f.x0 + gi * (_f.x1 - _f.x0) / {n - 1}D as x",
                        f"_f.y0 + gj * (_f.y1 - _f.y0) / {n - 1}D as y"))


def _ranges(df: DataFrame, x: str, y: str) -> Column:
    """Interquartile ranges of both axes as a scalar struct."""
    long = df.selectExpr(f"""inline(array(named_struct('axis', 'x', 'v', cast(`{x}` as double)),
                                          named_struct('axis', 'y', 'v', cast(`{y}` as double))))""")
    q = quantiles(long, "v", [0.25, 0.75], by=["axis"])
    return q.agg(F.expr("""struct(
        max(value) filter (where axis = 'x') - min(value) filter (where axis = 'x') as x,
        max(value) filter (where axis = 'y') - min(value) filter (where axis = 'y') as y)""")).scalar()


# Normal-reference bandwidth, a quarter of the plug-in rule:
# 4 * 1.06 * min(sd, IQR / 1.34) * n ** (-1/5) / 4.
def _bandwidth(axis: str) -> str:
    return f"1.06D * least(_f.s{axis}, _r.{axis} / 1.34D) * power(_f.n, -0.2D) as h{axis}"


def _kernel_sums(df: DataFrame, x: str, y: str, weight: str, n: int) -> DataFrame:
    facts = (df.sparkSession.range(1).select(_facts(df, x, y, weight).alias("_f"),
                                             _ranges(df, x, y).alias("_r"))
             .select(F.expr(f"struct(_f.*, {_bandwidth('x')}, {_bandwidth('y')})").alias("_g"))).scalar()

    def phi(v: str, at: str, width: str) -> str:
        return f"exp(-0.5D * (({at} - {v}) / {width}) * (({at} - {v}) / {width})) / sqrt(2D * pi())"

    rows = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"),
                     F.col(weight).cast("double").alias("_w"), facts.alias("_g"))
    rows = rows.selectExpr("_x", "_w", "_g", *[
        phi("_y", f"(_g.y0 + {j}D * (_g.y1 - _g.y0) / {n - 1}D)", "_g.hy") + f" as _k{j}" for j in range(n)])
    spread = rows.selectExpr("*", f"explode(sequence(0, {n - 1})) as gi")
    gx = f"(_g.x0 + gi * (_g.x1 - _g.x0) / {n - 1}D)"
    sums = (spread.withColumn("_wx", F.expr(f"_w * {phi('_x', gx, '_g.hx')}"))
            .groupBy("gi").agg(*[F.expr(f"sum(_wx * _k{j})").alias(f"z{j}") for j in range(n)])
            .withColumn("_g", facts))   # a struct among the sums would make it an aggregate that sorts all rows
    cells = ", ".join(f"named_struct('gj', {j}, 'ksum', z{j})" for j in range(n))
    return sums.selectExpr("gi", "_g", f"inline(array({cells}))")


def kernel_sums(df: DataFrame, x: str, y: str, weight: str, n: int = 25) -> DataFrame:
    """Sum of weight * phi(dx / hx) * phi(dy / hy) at every grid point.

    The kernel is a product, so a row is repeated once per grid column only (n
    times, inside the task) and the n grid rows are n sums of one aggregate;
    each task hands on at most n partial rows.
    """
    return _kernel_sums(df, x, y, weight, n).select("gi", "gj", "ksum")


def weighted_kde(df: DataFrame, x: str, y: str, weight: str, n: int = 25) -> DataFrame:
    """Weighted two-dimensional Gaussian density on an n x n grid."""
    return _kernel_sums(df, x, y, weight, n).selectExpr(
        "gi", "gj", f"_g.x0 + gi * (_g.x1 - _g.x0) / {n - 1}D as x",
        f"_g.y0 + gj * (_g.y1 - _g.y0) / {n - 1}D as y", "ksum / (_g.total * _g.hx * _g.hy) as z")


def variance_share(df: DataFrame, y: str, factors: Sequence[str]) -> DataFrame:
    """Between-group variance of ``y`` for each factor, and its share.

    A one-pass stand-in for crossed random intercepts; it is not equal to a REML
    fit.  Rows with any missing factor are dropped, as a model fit would.
    """
    complete = df.select(F.col(y).cast("double").alias("_y"),
                         *[F.col(f).cast("string").alias(f) for f in factors]).dropna("any")
    long = complete.unpivot(["_y"], list(factors), "factor", "level")
    groups = long.groupBy("factor", "level").agg(
        F.count("*").alias("_n"), F.sum("_y").alias("_s"), F.sum(F.col("_y") * F.col("_y")).alias("_q"))
    n, s = F.sum("_n"), F.sum("_s")
    per = groups.groupBy("factor").agg(
        F.count("*").alias("levels"),
        ((F.sum(F.col("_s") * F.col("_s") / F.col("_n")) - s * s / n) / n).alias("between_var"),
        ((F.sum("_q") - s * s / n) / n).alias("total_var"))
    whole = per.agg(F.sum("between_var")).scalar()
    return per.select("factor", "levels", "between_var",
                      F.try_divide("between_var", "total_var").alias("r_squared"),
                      F.try_divide(F.col("between_var"), whole).alias("_p")).select(
        "factor", "levels", "between_var", "r_squared", (F.col("_p") * F.lit(100.0)).alias("prop_var"))
