"""Ordered work on long series without a task that holds a whole one.

A group's rows are dealt to pieces that follow each other in the order; a small table of a row per
piece carries what earlier (or later) pieces add up to, and joins back.  Three tools come from it:

* ``numbered``: exact row numbers, from the numbers inside a piece and the counts of earlier pieces;
* ``chunks``: stretches of consecutive row numbers, each with a halo of the rows before and after
  it, so that lags and rolling windows of a group run in as many tasks as it has stretches;
* ``running``: running sums, maxima and minima in either direction, in two levels.

Pieces of timestamps are stretches of time; pieces of numbers lie between approximate quantiles, and
the rows of a value that is a quantile itself, which every very frequent value is, are dealt once
more by a hash, as equal values may be numbered in any order.  Nulls come first; keys may be null.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import staged

#: Rows of a stretch, seconds of a piece of timestamps, pieces of numbers between quantiles, and parts of an equal value.
ROWS, SECONDS, PIECES, PARTS = 4096, 4096 * 3600, 64, 16
_FIRST = -(1 << 62)


def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join in which null keys meet null keys; the right side's keys are dropped.  Without keys the right side is one row."""
    if not keys:
        return left.join(F.broadcast(right), how="cross" if how == "inner" else how)
    renamed = right.withColumnsRenamed({k: f"{k}_right_" for k in keys})
    met = left.join(renamed, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}_right_")) for k in keys)), how)
    return met.drop(*(f"{k}_right_" for k in keys))


def _pieces(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``piece_`` (its order is the order of the values) and ``part_``."""
    if isinstance(df.schema[order].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        piece = F.floor(F.unix_seconds(F.col(order).cast("timestamp")) / SECONDS)
        return df.withColumns({"piece_": F.coalesce(piece, F.lit(_FIRST)), "part_": F.lit(0)})
    v = F.col(order).cast("double")
    bounds = df.groupBy(*by).agg(F.percentile_approx(v, [k / PIECES for k in range(1, PIECES)], 1000).alias("bounds_"))
    b = F.col("bounds_")
    at = F.aggregate(b, F.lit(0).cast("long"), lambda n, q: n + (q < v).cast("long") + (q <= v).cast("long"))
    out = beside(df, bounds, by).withColumn("piece_", F.coalesce(F.when(F.isnan(v), F.lit(2 * PIECES).cast("long")).otherwise(at), F.lit(_FIRST)))
    part = F.when(F.array_contains(b, v), F.pmod(F.xxhash64(*df.columns), F.lit(PARTS)).cast("int")).otherwise(0)
    return out.withColumn("part_", part).drop("bounds_")


def numbered(df: DataFrame, by: list[str] = (), order: str = "timestamp", name: str = "pos_", total: str | None = None) -> DataFrame:
    """Adds the row number from 0 in each group's order, and the group's rows as ``total``; equal values get numbers in any order.

    Rows are dealt to pieces once; the numbers inside a piece and its count start from the same shuffle.
    """
    by = list(by)
    rows = _pieces(df, by, order).repartition(*by, "piece_", "part_")
    counts = rows.groupBy(*by, "piece_", "part_").agg(F.count(F.lit(1)).alias("n_"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))  # a row per piece
    before = whole.orderBy("piece_", "part_").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("n_").over(whole).alias(total)] if total else []
    offsets = counts.select(*by, "piece_", "part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("offset_"), *extra)
    nth = F.row_number().over(Window.partitionBy(*by, "piece_", "part_").orderBy(order)) - 1
    out = beside(rows.withColumn("nth_", nth), offsets, [*by, "piece_", "part_"])
    return out.withColumn(name, (F.col("nth_") + F.col("offset_")).cast("long")).drop("nth_", "offset_", "piece_", "part_")


def chunks(df: DataFrame, by: list[str] = (), order: str = "timestamp", before: int = 0, after: int = 0, rows: int | None = None) -> DataFrame:
    """Adds ``pos_``, ``chunk_`` and ``own_``: every stretch with copies of the ``before`` rows ahead of it and ``after`` rows behind it.

    A stretch is at least as long as its halo, so a row is copied twice at most.
    """
    size = max(rows or ROWS, before, after)
    own, at = F.floor(F.col("pos_") / size), F.col("pos_") % size
    copies = [F.struct(own.alias("chunk_"), F.lit(True).alias("own_"))]
    copies += [F.when(at >= size - before, F.struct((own + 1).alias("chunk_"), F.lit(False).alias("own_")))] if before else []
    copies += [F.when((at < after) & (own > 0), F.struct((own - 1).alias("chunk_"), F.lit(False).alias("own_")))] if after else []
    out = numbered(df, by, order).withColumn("copy_", F.explode(F.array_compact(F.array(*copies))))
    return out.select("*", "copy_.*").drop("copy_")


def window(by: list[str] = ()) -> WindowSpec:
    """Over the rows of ``chunks``, in order."""
    return Window.partitionBy(*by, "chunk_").orderBy("pos_")


def own(df: DataFrame) -> DataFrame:
    """The rows of ``chunks`` without halo copies and helper columns."""
    return df.filter("own_").drop("own_", "chunk_", "pos_")


def with_group(df: DataFrame, by: list[str], **made: Column) -> DataFrame:
    """Adds aggregates of each group by a join, where a window would bring a group's rows to one task."""
    return beside(df, df.groupBy(*by).agg(*(c.alias(n) for n, c in made.items())), list(by))


def running(df: DataFrame, by: list[str], order: str, made: dict[str, tuple[str, Column, str]], piece: Column | None = None) -> DataFrame:
    """Adds running aggregates: name -> (``sum``, ``max`` or ``min``; value; ``up``, ``before``, ``down`` or ``all``).

    ``up`` and ``down`` include the row itself, coming from the first or the last; ``before`` leaves
    it out (null at the first row); ``all`` is the group's.  The order has no equal values in a group.
    ``piece``: any column that grows with the order, to deal rows by instead of quantiles.
    """
    by = list(by)
    functions = {"sum": F.sum, "max": F.max, "min": F.min}
    joins = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}
    rows = df.withColumn("piece_", piece) if piece is not None else _pieces(df, by, order).drop("part_")
    rows = rows.withColumns({f"{n}_v_": v for n, (_, v, _) in made.items()}).repartition(*by, "piece_")
    inside = Window.partitionBy(*by, "piece_").orderBy(order)
    edges = {"up": (Window.unboundedPreceding, 0), "before": (Window.unboundedPreceding, -1), "down": (0, Window.unboundedFollowing), "all": (0, 0)}
    sums = rows.groupBy(*by, "piece_").agg(*(functions[f](f"{n}_v_").alias(f"{n}_p_") for n, (f, _, _) in made.items()))
    across = Window.partitionBy(*(by or [F.lit(0)])).orderBy("piece_")  # a row per piece
    beyond = {"up": (Window.unboundedPreceding, -1), "before": (Window.unboundedPreceding, -1), "down": (1, Window.unboundedFollowing), "all": (Window.unboundedPreceding, Window.unboundedFollowing)}
    carried = sums.select(*by, "piece_", *(functions[f](f"{n}_p_").over(across.rowsBetween(*beyond[d])).alias(f"{n}_c_") for n, (f, _, d) in made.items()))
    rows = rows.withColumns({f"{n}_l_": functions[f](f"{n}_v_").over(inside.rowsBetween(*edges[d])) for n, (f, _, d) in made.items()})
    out = beside(rows, carried, [*by, "piece_"])
    out = out.withColumns({n: F.col(f"{n}_c_") if d == "all" else joins[f](F.col(f"{n}_l_"), F.col(f"{n}_c_")) for n, (f, _, d) in made.items()})
    return out.drop("piece_", *(f"{n}_{x}_" for n in made for x in "vlc"))


def lagged_sums(df: DataFrame, by: list[str], value: str, most: int, order: str = "timestamp", rows: int | None = None) -> DataFrame:
    """``(by..., lag, n, mean, sx, sy, sxx, syy, sxy)`` for lags 0 to ``most``, as far as a group has rows.

    Sums over all pairs of a row and the row ``lag`` before it, of the values less the group's mean;
    ``sx`` is of the earlier rows.  Each stretch gives ``most + 1`` rows, whatever its length.  Rows
    without a value are left out.
    """
    by = list(by)
    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in by)
    slim = (df if getattr(df, "_tidemark_staged", False) else staged(df.select(*by, order, value))).filter(F.col(value).isNotNull()).select(*by, order, F.col(value).cast("double").alias("x_"))
    cut = chunks(with_group(slim, by, mean=F.avg("x_")), by, order, before=most, rows=rows)
    cut = cut.select(*by, "chunk_", "pos_", "own_", "mean", (F.col("x_") - F.col("mean")).alias("x_"))
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos_")
        x, at = pdf["x_"].to_numpy(), int((~pdf["own_"]).sum())
        out = []
        for k in range(most + 1):
            later = x[max(at, k) :]
            earlier = x[max(at, k) - k : len(x) - k]
            if len(later):
                out.append((k, len(later), earlier.sum(), later.sum(), earlier @ earlier, later @ later, earlier @ later))
        made = pd.DataFrame(out, columns=["lag", *names])
        return made.assign(mean=pdf["mean"].iloc[0], **{k: pd.Series([pdf[k].iloc[0]] * len(made), dtype=object) for k in by})[[*by, "lag", "mean", *names]]

    sums = cut.groupBy(*by, "chunk_").applyInPandas(products, f"{kinds}lag int, mean double, n bigint, sx double, sy double, sxx double, syy double, sxy double")
    return sums.groupBy(*by, "lag").agg(F.sum("n").alias("n"), F.first("mean").alias("mean"), *(F.sum(c).alias(c) for c in names[1:]))


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``(by..., name...)``: exact quantiles with linear interpolation, from the two rows beside each.

    Only rows at the sought numbers leave their piece; no group is ever held or counted by value in one task.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("x_"))
    rows = numbered(rows, by, "x_", total="n_")
    made = []
    for name, p in shares.items():
        at = (F.col("n_") - 1) * p
        low = F.floor(at + 1e-9)
        made += [F.max(F.when(F.col("pos_") == low, F.col("x_"))).alias(f"{name}_lo_"), F.max(F.when(F.col("pos_") == F.least(low + 1, F.col("n_") - 1), F.col("x_"))).alias(f"{name}_hi_"), F.max(F.greatest(at - low, F.lit(0.0))).alias(f"{name}_w_")]
    g = rows.groupBy(*by).agg(*made)
    return g.select(*by, *((F.col(f"{n}_lo_") + (F.col(f"{n}_hi_") - F.col(f"{n}_lo_")) * F.col(f"{n}_w_")).alias(n) for n in shares))


#: Coefficients of the rational approximations of the normal quantile (Wichura, AS 241), highest power last.
_NEAR = ([3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3], [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3])
_TAIL = ([1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4], [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9])
_FAR = ([6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7], [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])


def _ratio(x: Column, parts: tuple[list[float], list[float]]) -> Column:
    top, bottom = (reduce(lambda s, c: s * x + c, reversed(p[:-1]), F.lit(p[-1])) for p in parts)
    return top / bottom


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of 0 < p < 1 to about 16 digits; null elsewhere."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _ratio(r - 1.6, _TAIL)).otherwise(_ratio(r - 5, _FAR))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, _NEAR)).otherwise(F.signum(q) * tail))


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    """The same for arrays, by the same approximations."""
    p = np.asarray(p, float)
    ratio = lambda x, c: np.polyval(c[0][::-1], x) / np.polyval(c[1][::-1], x)
    q = p - 0.5
    r = np.sqrt(-np.log(np.clip(np.minimum(p, 1 - p), 1e-300, None)))
    return np.where(np.abs(q) <= 0.425, q * ratio(0.180625 - q * q, _NEAR), np.sign(q) * np.where(r <= 5, ratio(r - 1.6, _TAIL), ratio(r - 5, _FAR)))
