"""Importance resampling against brute force, and its edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import EDGE, LONG, docs, lower
from tideline.llm import common, resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def runs(text, grams):
    w = WORD.findall(lower(text))
    return len(w), [" ".join(w[k : k + n]) for n in range(1, grams + 1) for k in range(len(w) - n + 1)]


def brute(rows, target, grams, buckets, least, share):
    def name(f):
        return zlib.crc32(f.encode()) % buckets

    own = [runs(t, grams) for _, t in rows]
    s, t = Counter(name(f) for _, fs in own for f in fs), Counter(name(f) for x in target for f in runs(x, grams)[1])
    big, small = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (small + buckets)))) for b in s}
    out = []
    for (i, _), (words, fs) in zip(rows, own):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[name(f)] for f in fs)
        out.append([i, words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0]))
    for k, x in enumerate(able):
        x.append(k + 1 if k < len(able) * share[0] // share[1] else None)
    return sorted((tuple(x) if len(x) == 6 else (*x, None) for x in out), key=repr)


@pytest.mark.parametrize("grams, buckets, share", [(1, 10_000, (10, 100)), (1, 7, (1, 2)), (3, 10_000, (1, 3))])
def test_resampling_brute_force(spark, grams, buckets, share):
    rng = np.random.default_rng(grams + buckets)
    rows = [(k, " ".join(f"V{x}é" if x % 3 else "the-x" for x in rng.integers(0, 60, rng.integers(0, 70)))) for k in range(90)]
    rows += [(k, "the " * 50) for k in range(100, 140)] + [(200, "w" * 300 + " " + "é" * 90), (201, LONG)] + EDGE[:4] + [(7, "Ünïcode x́ 🙂 text"), (None, "a")]
    target = ["v1é v2é the x", None, "", "the the V4é"]
    got = resampling.resample(docs(spark, rows), docs(spark, list(enumerate(target))), share, 20, grams, buckets)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, target, grams, buckets, 20, share)


def test_stretches_and_repeated_rows(spark, monkeypatch):
    """Stretches that go over batches, and rows that repeat everything."""
    rows = [(k % 5, "a b c " * 9) for k in range(3000)] + [(9, "d " * 25)] * 3
    got = resampling.resample(docs(spark, rows).coalesce(1), docs(spark, [(1, "d")]), least=20, share=(1, 1))
    want = brute(rows, ["d"], 1, 10_000, 20, (1, 1))
    got = [tuple(r) for r in got.collect()]
    assert sorted(r[5] for r in got) == list(range(1, 3004))
    assert sorted(r[:5] for r in got) == sorted(r[:5] for r in want)


def test_resampling_empty(spark):
    assert resampling.resample(docs(spark, []), docs(spark, [(1, "a")])).count() == 0
    got = resampling.resample(docs(spark, EDGE), docs(spark, [])).collect()
    assert len(got) == len(EDGE) and all(r["weight"] == 0 for r in got if not r["n_words"])


def test_crc_of_ranges():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 4000, 300)
    ends = starts + rng.choice([0, 1, 5, 63, 64, 65, 900], 300)
    got = common.crc_ranges(data, starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    on = common.crc_ranges(data, starts[::-1].copy(), ends[::-1].copy(), got)
    assert on.tolist() == [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(starts[::-1], ends[::-1], got)]
    assert pa.array(got).type == pa.uint32()
