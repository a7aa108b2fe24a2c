"""Peaks of a short series held as an array, with prominence and width, as columns.

One fold finds the peaks: going up it keeps the highest value since the last low, and
tops of that height are peaks once the series has come down from them by the asked
prominence; going down it keeps the lowest value till the series has risen by as much.
Those are just the tops that stand that high above the lowest value on both sides before
a higher one.  Only what is found is then measured for its width.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALLEST = 5e-324


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def prominent(v: Column, prominence: float) -> Column:
    """Positions of tops with at least this prominence, by one fold."""
    none, least = F.array().cast("array<int>"), max(prominence, SMALLEST)

    def step(s: Column, x: Column) -> Column:
        top = F.coalesce(s["up"] & (x < s["last"]) & (s["last"] == s["far"]), F.lit(False))
        tops = F.when(top, F.concat(s["tops"], F.array(F.shiftright(s["start"] + s["at"] - 1, 1)))).otherwise(s["tops"])
        down, up = s["rising"] & (s["far"] - x >= least), ~s["rising"] & (x - s["far"] >= least)
        on = down | up | F.when(s["rising"], x > s["far"]).otherwise(x < s["far"]) | s["far"].isNull()
        return F.struct(
            (s["at"] + 1).alias("at"),
            F.when(x == s["last"], s["start"]).otherwise(s["at"]).alias("start"),
            x.alias("last"),
            F.when(x > s["last"], True).when(x == s["last"], s["up"]).otherwise(False).alias("up"),
            F.when(down, False).when(up, True).otherwise(s["rising"]).alias("rising"),
            F.when(on, x).otherwise(s["far"]).alias("far"),
            F.when(on, none).otherwise(tops).alias("tops"),
            F.when(down, F.concat(s["found"], tops)).otherwise(s["found"]).alias("found"),
        )

    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(None).cast("double").alias("last"), F.lit(False).alias("up"),
        F.lit(False).alias("rising"), F.lit(None).cast("double").alias("far"), none.alias("tops"), none.alias("found"),
    )
    return F.aggregate(v, start, step, lambda s: s["found"])


def _first(v: Column, p: Column, test: Callable[[Column], Column]) -> Column:
    """Places from p on to the first value that passes the test; 0 if none does."""
    after = F.slice(v, p + 2, F.size(v))
    return F.array_position(F.transform(after, lambda x: F.coalesce(test(x), F.lit(False))), True).cast("int")


def _low(v: Column, p: Column) -> Column:
    """The lowest value from p on before a higher one."""
    k = _first(v, p, lambda x: x > v[p])
    return F.array_min(F.slice(v, p + 1, F.when(k == 0, F.size(v)).otherwise(k)))


def _down(v: Column, p: Column, h: Column) -> Column:
    """Where the series, drawn with straight lines, has come down to h: k places on from p,
    less the part f of one."""
    return let(
        _first(v, p, lambda x: x <= h),
        lambda k: F.struct(k.alias("k"), F.when(v[p + k] < h, (h - v[p + k]) / (v[p + k - 1] - v[p + k])).otherwise(0.0).alias("f")),
    )


def peaks(v: Column, prominence: float, width: float | None = None) -> Column:
    """Positions (from 0) in the array of doubles ``v`` of local maxima (the lower middle of
    a plateau, never an end) whose prominence is at least ``prominence`` and, if given,
    whose width at half of it is at least ``width``.  NaN counts as null; a null is no peak,
    nor are its neighbours' tops that border on it, and the series goes on behind it."""
    v = F.transform(v, lambda x: F.nanvl(x, F.lit(None).cast("double")))
    if width is None:
        return prominent(v, prominence)

    def wide(v: Column, back: Column, p: Column) -> Column:
        q = F.size(v) - 1 - p
        height = v[p] - (v[p] - F.greatest(_low(v, p), _low(back, q))) / 2
        ends = let(height, lambda h: F.struct(_down(v, p, h).alias("on"), _down(back, q, h).alias("off")))
        return let(ends, lambda e: (p + e["on"]["k"] - e["on"]["f"]) - (p - e["off"]["k"] + e["off"]["f"]) >= width)

    return let(v, lambda v: let(F.reverse(v), lambda back: F.filter(prominent(v, prominence), lambda p: wide(v, back, p))))
