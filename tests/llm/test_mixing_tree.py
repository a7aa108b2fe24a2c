"""The hand-over between ranges as a tree: the same as one run, in tasks of bounded size."""

import random

import numpy as np
import pytest

from tideline.llm import mixing


@pytest.mark.parametrize("fan, count", [(2, 9), (3, 9), (64, 9), (2, 40)])
def test_tree_of_ranges_gives_one_run(spark, fan, count):
    rng = np.random.default_rng(count)
    sizes = [(i, int(n), float(w)) for i, (n, w) in enumerate(zip(rng.integers(1, 300, count), rng.uniform(0.001, 1, count)))]
    windows = mixing.block_windows(spark.createDataFrame(sizes, "sid long, blocks long, w double"))
    total = sum(n for _, n, _ in sizes)
    sent, left = mixing.earliest_first(windows.toPandas(), 0, total)
    got = sorted(tuple(r) for r in mixing.schedule(windows, count, span=1, fan=fan).select("slot", "sid", "k").collect())
    assert left == [] and got == [(t, i, k) for t, (_, i, k) in enumerate(sent)]
    assert total > 8 * count * fan**2 or fan > 3  # several levels


def test_joined_stretches_act_like_one():
    """Over random stretches: what waits behind them, told by one, two or all at once."""
    rng = random.Random(0)
    for _ in range(300):
        few = rng.randrange(1, 5)

        def some(n):
            return [(rng.randrange(50), rng.randrange(9), rng.randrange(10**6)) for _ in range(n)]

        parts = [(some(rng.randrange(few + 1)), some(rng.randrange(30)) + [mixing.IDLE] * rng.randrange(3)) for _ in range(rng.randrange(1, 6))]
        waits = some(rng.randrange(few + 1))
        want = waits
        for left, sent in parts:
            want = mixing.after(left, sent, want)
        cut = rng.randrange(len(parts) + 1)
        for split in ([parts], [parts[:cut], parts[cut:]]):
            got = waits
            for some_parts in split:
                got = mixing.after(*mixing.joined(some_parts, 100), got)
            assert sorted(got) == sorted(want)
        tight = mixing.joined([mixing.joined([(left, sorted(sent)[-3 * 8 :])], 2 * 8) for left, sent in parts], 8)
        assert sorted(mixing.after(*tight, waits)) == sorted(want)
