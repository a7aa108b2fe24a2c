"""Exact quantiles without a group in one task.

Values are counted by group and value, before and after the shuffle; counts are added up
along ranges of (group, value), so that each value knows the ranks it stands for; and the
ranks asked for are read off.  A group of any size is as many rows as it has distinct
values, spread over the ranges, where ``percentile`` holds them all in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import running_total
from .tables import settle


def _pick(p: float, n: Column, first: Column, last: Column, value: Column) -> tuple[Column, Column, Column]:
    """The values at the two ranks around a quantile, and how far it is to the second."""
    at = (n - 1) * F.lit(float(p))
    low, high = (F.max(F.when((r >= first) & (r <= last), value)) for r in (F.floor(at), F.ceil(at)))
    return low, high, F.max(at - F.floor(at))


def exact_quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``by`` and a column for each of ``wanted`` (name to share between 0 and 1): linear
    between the two nearest ranks, nulls left out.  A group of nulls alone has null
    quantiles; without ``by`` the table is one group.  A null in ``by`` is a group."""
    value_of, key = F.col("_k")["v"], F.struct(*[F.col(b) for b in by], F.col(value).cast("double").alias("v"))
    groups = F.struct(*[F.col("_k")[b].alias(b) for b in by], F.lit(0).alias("_one"))
    counts = rows.where(F.col(value).isNotNull()).groupBy(key.alias("_k")).agg(F.count(F.lit(1)).alias("_c"))
    upto = running_total(counts, "_k", F.col("_c"), "_upto").select(groups.alias("_g"), value_of.alias("_v"), "_c", "_upto")
    upto = settle(upto, "ranks")
    sizes = upto.groupBy("_g").agg(F.sum("_c").alias("_n"), F.min(F.col("_upto") - F.col("_c")).alias("_start"))
    ranked = upto.join(sizes, "_g")
    last = F.col("_upto") - F.col("_start") - 1
    first = last - F.col("_c") + 1
    picked = {}
    for k, p in enumerate(wanted.values()):
        picked |= {f"_{part}{k}": c for part, c in zip(("low", "high", "part"), _pick(p, F.col("_n"), first, last, F.col("_v")))}
    found = ranked.groupBy("_g").agg(*[c.alias(k) for k, c in picked.items()])
    between = {name: F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * F.col(f"_part{k}") for k, name in enumerate(wanted)}
    return found.select(*[F.col("_g")[b].alias(b) for b in by], *[c.alias(name) for name, c in between.items()])


def with_quantiles(summary: DataFrame, rows: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """``summary``, a row a group, with the quantiles of ``rows``."""
    found = exact_quantiles(rows, by, value, wanted).select(*[F.col(b).alias(f"_{b}") for b in by], *wanted)
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    return summary.join(found, same, "left").drop(*[f"_{b}" for b in by])
