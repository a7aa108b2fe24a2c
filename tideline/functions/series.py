"""Primitives over an ordered series: pure column builders on one window specification.

Every builder uses the same partitioning and order, so any number of them shares one
exchange and one sort.  Positions come as ``i`` (from 0) and ``n`` (points in the series).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .tables import settle

EPS = 1e-10


def series(key="transect_id", order="distance") -> WindowSpec:
    keys = [key] if isinstance(key, str) else key
    return Window.partitionBy(*keys).orderBy(order)


def whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def indexed(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Adds i, the position from 0, and n, the length of the series."""
    return df.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(whole(w)))


def gradient(f, w: WindowSpec, d="distance") -> Column:
    """Second-order central differences on uneven spacing, one-sided at the ends; null
    for a series of one point and where two distances are equal."""
    f, d = F.col(f) if isinstance(f, str) else f, F.col(d) if isinstance(d, str) else d
    fm, fp, dm, dp = F.lag(f).over(w), F.lead(f).over(w), F.lag(d).over(w), F.lead(d).over(w)
    h0, h1 = d - dm, dp - d
    inner = F.try_divide(h0 * h0 * fp + (h1 * h1 - h0 * h0) * f - h1 * h1 * fm, h0 * h1 * (h0 + h1))
    return F.when(dm.isNull(), F.try_divide(fp - f, h1)).when(dp.isNull(), F.try_divide(f - fm, h0)).otherwise(inner)


def gradient_by_index(f, w: WindowSpec) -> Column:
    f = F.col(f) if isinstance(f, str) else f
    fm, fp = F.lag(f).over(w), F.lead(f).over(w)
    return F.when(fm.isNull(), fp - f).when(fp.isNull(), f - fm).otherwise((fp - fm) / 2)


def uniform(f, size: int, w: WindowSpec, truncate: bool = False) -> Column:
    """Centred moving mean of odd ``size``, edges padded with the end values.  With
    ``truncate`` the mean is cut to an integer, as for a band of integer type."""
    f, k = F.col(f) if isinstance(f, str) else f, size // 2
    total = (
        F.sum(f).over(w.rowsBetween(-k, k))
        + F.greatest(F.lit(0), F.lit(k) - F.col("i")) * F.first(f).over(whole(w))
        + F.greatest(F.lit(0), F.lit(k) - (F.col("n") - 1 - F.col("i"))) * F.last(f).over(whole(w))
    )
    mean = total / size
    return F.floor(mean).cast("double") if truncate else mean


def centred(agg, f, w: WindowSpec, k: int = 3) -> Column:
    """An aggregate over rows -k..k, clipped at the ends."""
    return agg(f).over(w.rowsBetween(-k, k))


def local_minimum(g, w: WindowSpec) -> Column:
    """No neighbour is smaller; every point of a plateau counts."""
    g = F.col(g) if isinstance(g, str) else g
    prev, after = F.lag(g).over(w), F.lead(g).over(w)
    return ~F.coalesce(g > prev, F.lit(False)) & ~F.coalesce(g > after, F.lit(False))


def median3(c, w: WindowSpec) -> Column:
    """Median of a point and its neighbours; an end is its own missing neighbour."""
    c = F.col(c) if isinstance(c, str) else c
    a, b = F.coalesce(F.lag(c).over(w), c), F.coalesce(F.lead(c).over(w), c)
    return F.array_sort(F.array(a, c, b))[1]


def run_number(c, w: WindowSpec) -> Column:
    """0 for the first run of equal values, 1 for the next: needs ``changed`` summed over
    the series, so pass the column of ``changed``."""
    return F.sum(F.col(c).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))


def changed(c, w: WindowSpec) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c != F.lag(c).over(w), F.lit(False))


def forward(agg, f, w: WindowSpec, a: int, b: int) -> Column:
    return agg(f).over(w.rowsBetween(a, b))


def savitzky_golay(f, w: WindowSpec) -> Column:
    """Window 5, order 2; at the ends the parabola through the first or last five points
    by least squares.  Null for fewer than five points.  Needs i and n."""
    f = F.col(f) if isinstance(f, str) else f
    kernel = {-2: -3, -1: 12, 0: 17, 1: 12, 2: -3}

    def at(k: int) -> Column:
        return F.lag(f, -k).over(w) if k < 0 else F.lead(f, k).over(w) if k else f

    inner = sum((at(k) * c for k, c in kernel.items()), F.lit(0.0)) / 35
    # rows of the projection of five points on parabolas, at the first two points (times 35)
    end = {0: (31, 9, -3, -5, 3), 1: (9, 13, 12, 6, -5)}
    out = F.when(F.col("n") < 5, F.lit(None))
    for p, c in end.items():
        out = out.when(F.col("i") == p, sum((at(k - p) * x for k, x in enumerate(c)), F.lit(0.0)) / 35)
        out = out.when(
            F.col("i") == F.col("n") - 1 - p, sum((at(p - k) * x for k, x in enumerate(c)), F.lit(0.0)) / 35
        )
    return out.otherwise(inner)


def repeated(f: Column, k: int, w: WindowSpec) -> Column:
    """The value k places on, or the end value beyond an end.  Needs i and n."""
    if not k:
        return f
    over = whole(w)
    if k < 0:
        return F.when(F.col("i") < -k, F.first(f).over(over)).otherwise(F.lag(f, -k).over(w))
    return F.when(F.col("i") + k >= F.col("n"), F.last(f).over(over)).otherwise(F.lead(f, k).over(w))


def kernel(f: Column, weights: list[float], w: WindowSpec) -> Column:
    """The sum of an odd number of neighbours by ``weights``, end values repeated."""
    half = len(weights) // 2
    return sum((repeated(f, k - half, w) * float(c) for k, c in enumerate(weights)), F.lit(0.0))


def median(f: Column, size: int, w: WindowSpec) -> Column:
    """The running median of an odd number of neighbours, end values repeated."""
    half = size // 2
    return F.array_sort(F.array(*[repeated(f, k, w) for k in range(-half, half + 1)]))[half]


def smoothed(f, w: WindowSpec, method: str, size: int = 3, sigma: float = 1.0, order: int = 2) -> Column:
    """Smoothing by name: ``uniform``, ``median`` or ``savgol`` (of degree ``order``) over an
    odd ``size``, or ``gaussian`` with ``sigma`` (cut at four of them); end values are
    repeated.  Needs i and n."""
    f = F.col(f) if isinstance(f, str) else f
    if method == "gaussian":
        half = int(4 * sigma + 0.5)
        weights = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
        return kernel(f, weights / weights.sum(), w)
    if size < 1 or size % 2 == 0:
        raise ValueError("the size of a smoothing is odd")
    if method == "uniform":
        return kernel(f, [1 / size] * size, w)
    if method == "median":
        return median(f, size, w)
    if method == "savgol":
        if order >= size:
            raise ValueError("a polynomial needs more points than its degree")
        at = np.vander(np.arange(size) - size // 2, order + 1, increasing=True)
        return kernel(f, np.linalg.pinv(at)[0], w)
    raise ValueError(f"no smoothing is called {method}")


def running_total(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one by ``key`` (distinct), without
    sorting the table in one task: ranges of the key are summed each for itself, and only
    one sum a range is added up."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, key).withColumn("_pid", F.spark_partition_id()).withColumn("_v", value)
    parts = settle(parts, "ranges")  # both uses see the same ranges
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("_pid").agg(F.sum("_v").alias("_s"))
    starts = sums.select("_pid", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))  # n rows at most
    within = Window.partitionBy("_pid").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumn("_t", F.sum("_v").over(within)).join(F.broadcast(starts), "_pid")
    return out.withColumn(name, F.col("_t") + F.col("_start")).drop("_pid", "_v", "_t", "_start")
