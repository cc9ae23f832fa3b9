"""Exact quantiles with linear interpolation between order statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .joins import null_safe_join

PART_ROWS = 1_000_000    # distinct (group, value) rows one task may hold
CUTS = 64                # parts a larger one is cut into per pass


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
              method: str = "distributed") -> DataFrame:
    """One row per group and probability: (*by, prob, value).

    ``distributed`` is exact at any size.  ``hash`` is Spark's ``percentile``,
    which keeps the distinct values of a group in one task; use it where those
    are bounded (ages, area averages).  ``sketch`` is ``percentile_approx``.
    """
    if method == "distributed":
        return distributed_quantiles(df, value, probs, by)
    listed = _listed(probs)
    agg = {"hash": f"percentile(cast(`{value}` as double), {listed})",
           "sketch": f"percentile_approx(cast(`{value}` as double), {listed}, 100000)"}[method]
    return _rows(df.groupBy(*by).agg(F.expr(agg).alias("_q")), probs, by)


def _listed(probs: Sequence[float]) -> str:
    return "array(" + ", ".join(f"{float(p)!r}D" for p in probs) + ")"


def _rows(df: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Arrays of quantiles ``_q`` as rows; groups without values give none."""
    return (df.where("_q is not null")
            .select(*by, F.expr(f"""inline(transform(_q, (q, i) ->
                named_struct('prob', {_listed(probs)}[i], 'value', q)))""")))


def distributed_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                          by: Sequence[str] = (), part_rows: int = PART_ROWS) -> DataFrame:
    """Exact quantiles that never bring one group's values into one task.

    Equal values are counted together first, and the counts are saved to the shared folder
    (an action), so all steps see one set of values.  A group with more than ``part_rows``
    distinct values is cut at its own approximate quantiles, so by weight; exact counts
    of the parts tell which of them hold a wanted rank, only those are kept and saved, and
    parts still too large are cut again.  At last the values of each part are ranked.
    The values picked, and so the answer, do not depend on the cutting.
    """
    keys = [f"`{c}`" for c in by]
    rows = saved(df.where(F.col(value).isNotNull())
                 .groupBy(*by, F.col(value).cast("double").alias("_v"))
                 .agg(F.count("*").alias("_c")).withColumn("_part", F.lit(0).cast("bigint")), "value-counts")
    ranks = ", ".join(f"cast({fn}((_n - 1) * {float(p)!r}D) as bigint)"
                      for p in probs for fn in ("floor", "ceil"))
    parts = saved(rows.groupBy(*by, "_part").agg(F.sum("_c").alias("_n"), F.count("*").alias("_rows"))
                  .selectExpr(*keys, "_part", "_n", "_rows", "0L as _off",
                              f"array_sort(array_distinct(array({ranks}))) as _ranks"), "value-parts")
    while (parts.agg(F.max("_rows")).first()[0] or 0) > max(part_rows, 1):
        large = parts.where(F.col("_rows") > max(part_rows, 1)).select(*by, "_part")
        at = ", ".join(f"{k / CUTS!r}D" for k in range(1, CUTS))
        cuts = (null_safe_join(rows, large, [*by, "_part"], "left_semi").groupBy(*by, "_part")
                .agg(F.expr(f"array_distinct(percentile_approx(_v, array({at}), 10000))").alias("_cuts")))
        cuts = saved(cuts, "value-cuts")
        # the cuts below a value number its part; a part that did not change keeps place 0
        placed = null_safe_join(rows, cuts, [*by, "_part"], "left").selectExpr(
            *keys, f"_part * {CUTS + 1} + coalesce(size(filter(_cuts, x -> x < _v)), 0) as _sub", "_part", "_v", "_c")
        sizes = placed.groupBy(*by, "_part", "_sub").agg(F.sum("_c").alias("_m"), F.count("*").alias("_sub_rows"))
        before = f"sum(_m) over (partition by {', '.join([*keys, '_part'])} order by _sub) - _m"
        parts = saved(null_safe_join(sizes.withColumn("_before", F.expr(before)), parts, [*by, "_part"]).selectExpr(
            *keys, "_sub as _part", "_n", "_sub_rows as _rows", "_off + _before as _off",
            "filter(_ranks, r -> r >= _off + _before and r < _off + _before + _m) as _ranks")
            .where("size(_ranks) > 0"), "value-parts")
        rows = saved(null_safe_join(placed.selectExpr(*keys, "_sub as _part", "_v", "_c"),
                                    parts.select(*by, "_part"), [*by, "_part"], "left_semi"), "value-counts")

    place = ", ".join([*keys, "_part"])
    found = (null_safe_join(rows, parts, [*by, "_part"])
             .selectExpr(*keys, "_v", "_c", "_n", "_ranks",
                         f"_off + sum(_c) over (partition by {place} order by _v) as _upto")
             .selectExpr(*keys, "_v", "_n",
                         "explode(filter(_ranks, r -> r >= _upto - _c and r < _upto)) as _r")
             .groupBy(*by).agg(F.any_value("_n").alias("_n"),
                               F.expr("map_from_entries(collect_list(struct(_r, _v)))").alias("_at")))

    def interpolated(p: float) -> str:
        h = f"((_n - 1) * {p!r}D)"
        lo, hi = (f"element_at(_at, cast({fn}({h}) as bigint))" for fn in ("floor", "ceil"))
        return f"if({lo} = {hi}, {lo}, {lo} + ({hi} - {lo}) * ({h} - floor({h})))"

    values = ", ".join(interpolated(float(p)) for p in probs)
    return _rows(found.where("_n is not null").selectExpr(*keys, f"array({values}) as _q"), probs, by)


def top_percentile(df: DataFrame, value: str, p: float, method: str = "distributed") -> DataFrame:
    """Rows at or above the p-quantile; the threshold is a scalar subquery.

    The rows are saved first: sums of floats that are computed twice may differ in the
    last digit, and the threshold row would fall out.
    """
    df = saved(df, "percentile-rows")
    cut = quantiles(df, value, [p], method=method).select("value")
    return df.where(F.col(value) >= cut.scalar())
