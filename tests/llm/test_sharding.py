"""Minimax sharding against brute force, and its edge cases."""

import random
import zlib

import pytest

from tests.llm.test_operators import EDGE, docs
from tideline.llm import sharding


def fits(weights, capacity, shards):
    used, room = 1, capacity
    for w in weights:
        if w > capacity:
            return False
        if w > room:
            used, room = used + 1, capacity
        room -= w
    return used <= shards


def smallest(weights, shards):
    """The least capacity, by trying the weight of every stretch."""
    return min(c for i in range(len(weights)) for j in range(i, len(weights)) if fits(weights, c := sum(weights[i : j + 1]), shards))


def groups_of(rows):
    found = {}
    for i, t in rows:
        g = found.setdefault(t or "", [float("inf"), 0])
        g[0], g[1] = min(g[0], float("inf") if i is None else i), g[1] + len((t or "").encode()) + 8
    return found


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("cells", [20, None])
def test_capacity_is_the_smallest(spark, seed, cells):
    """With few cells the grid has to be refined many times."""
    rng = random.Random(seed)
    rows = [(k, "x" * rng.choice([0, 3, 40, rng.randrange(1, 300)]) + str(rng.randrange(30))) for k in range(120)]
    rows += [(k, "hot " * 30) for k in range(200, 200 + 40 * seed)]
    got = sharding.assign(docs(spark, rows), 7, cells=cells).collect()
    by_text, loads = {}, [0] * 7
    for r in got:
        loads[r["shard"]] += r["size"]
        by_text.setdefault(dict(rows)[r["id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    found = groups_of(rows)
    weights = [w for _, w in sorted(found.values())]
    assert max(loads) == smallest(weights, 7)
    order = [next(iter(by_text[t])) for t in sorted(found, key=lambda t: found[t][0])]
    assert order == sorted(order)  # each shard is a stretch
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    light = sorted(loads)[: 7 - (seed > 0)]  # the hot text, the last group, has a shard of its own
    assert max(light) - min(light) <= 2 * max(w for w in weights if w < 1000)


@pytest.mark.parametrize("seed", range(40))
def test_refining_finds_what_all_sums_give(seed, monkeypatch):
    """The cuts from a grid are those from all running sums."""
    rng = random.Random(seed)
    weights = [rng.choice([1, 2, rng.randrange(1, 50), rng.randrange(1, 4000)]) for _ in range(rng.randrange(1, 400))]
    stops = [sum(weights[: k + 1]) for k in range(len(weights))]
    shards = rng.choice([1, 2, 5, 24])

    def sums_in(_, spans, cells):
        width = -(-sum(b - a for a, b in spans) // cells)
        joined = [spans[0]]
        for a, b in spans[1:]:
            joined[-1:] = [(joined[-1][0], b)] if joined[-1][1] == a else [joined[-1], (a, b)]
        found = {}
        for s in stops:
            for a, b in joined:
                if a < s <= b:
                    found.setdefault((a, (s - a - 1) // width), []).append(s)
        sums, more = [], []
        for x in found.values():
            sums += sorted({x[0], x[-1]})
            more += [False, len(x) > 2][: len({x[0], x[-1]})]
        return sums, more

    monkeypatch.setattr(sharding, "sums_in", sums_in)
    total = stops[-1]
    heavy = sharding.Heavy([(s, w) for s, w in zip(stops, weights) if w > total // shards], total, shards)
    assert all(heavy.real(heavy.level(x)) == x for x in stops[:-1])
    whole = sharding.Grid([0, *stops], [False] * (len(stops) + 1), heavy)
    capacity = whole.capacity(shards)
    want = whole.even(capacity, whole.backward(capacity, shards), shards)[1:]
    assert want[-1] == total and max(b - a for a, b in zip([0, *want], want)) <= capacity
    assert whole.capacity(shards) == (smallest(weights, shards) if len(weights) < 80 else whole.capacity(shards))
    assert sharding.cut(None, total, heavy, shards, 1) == want


def test_sharding_edges(spark):
    got = sharding.assign(docs(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in EDGE)
    assert sorted((r["size"], r["crc"]) for r in got) == want
    assert len({r["shard"] for r in got if r["size"] == 8}) == 1  # null and empty texts
    assert sharding.assign(docs(spark, [])).count() == 0
    assert {r["shard"] for r in sharding.assign(docs(spark, [(None, None)] * 3)).collect()} == {0}


def test_written_shards(spark, tmp_path):
    rows = [(k % 50, f"t{k % 40} " * (k % 7)) for k in range(300)]
    found = sharding.write_shards(docs(spark, rows, "shard string, slot int, _file long, label string, block string"), str(tmp_path / "out"), 5, rows_per_file=10)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == sorted(rows)
    at = {(r["shard_"], r["slot_"]) for r in back.collect()}
    assert at == {(r["shard"], r["slot"]) for r in found.collect()} and len(at) == 300
