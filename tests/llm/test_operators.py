"""Corpus operators against brute force, and their edge cases: nulls, empty and long
texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import common, components, embedding_dedup, exact_dedup, labelled, mixing, packing, pii, quality, simhash_dedup, substring_dedup, toxicity, url_filter

SEP = "[^\x20\x09-\x0d]+"
LONG = " ".join(f"w{k % 977}" for k in range(60_000))


def docs(spark, rows, more="h string, id int, count long, label string, block string"):
    """doc_id, text and columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "h", 1, 2, "l", "b") for i, t in rows], "doc_id long, text string, " + more)


EDGE = [(1, None), (2, ""), (3, "a"), (4, " \t\n"), (5, LONG), (6, LONG), (6, LONG), (7, "Ünïcode x́ 🙂 text"), (None, "a")]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def groups(n, links):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


# --------------------------------------------------------------------- words


def test_words_are_the_patterns():
    texts = [t for _, t in EDGE] + ["  lead", "trail \n", "x"]
    import pyarrow as pa

    data, offsets = common.utf8(pa.array(texts))
    starts, ends, first = common.find_words(data, offsets)
    got = [[data[a:b].tobytes().decode() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])] for k in range(len(texts))]
    assert got == [re.findall(SEP, t or "") for t in texts]


# ----------------------------------------------------------------- substrings


def brute_substrings(rows, window):
    words = [re.findall(SEP, t or "") for _, t in rows]
    seen = {}
    for w in words:
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone |= set(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [1, 3, 35])
def test_substrings_brute_force(spark, window):
    rng = np.random.default_rng(window)
    rows = [(k, " ".join(f"v{x}" for x in rng.integers(0, 40, rng.integers(0, 60)))) for k in range(40)]
    rows += [(100, rows[3][1] + "\n" + rows[4][1]), (101, rows[3][1]), (101, rows[3][1]), (102, "q " * 80)] + [(i, t) for i, t in EDGE if t != LONG]
    got = substring_dedup.remove_repeats(docs(spark, rows), window).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_substrings(rows, window)


def test_substring_edges(spark):
    got = {(r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs(spark, EDGE)).collect()}
    assert got == {(1, 0), (2, 0), (3, 0), (4, 0), (5, 60_000), (6, 60_000), (7, 0), (None, 0)}
    spans = substring_dedup.remove_repeats(docs(spark, EDGE)).where("doc_id = 5").first()["removed"]
    assert spans == [[0, 60_000]]
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


def thue_morse(first):
    """A word of 4096 letters; the two of them share every polynomial hash modulo 2**64."""
    w = first
    while len(w) < 4096:
        w += w.translate(str.maketrans("ab", "ba"))
    return w


def test_equal_hashes_of_different_words(spark):
    """Windows are the same only if their words are."""
    tail = " ".join(f"u{k}" for k in range(34))
    one, two = thue_morse("a") + " " + tail, thue_morse("b") + " " + tail
    got = substring_dedup.remove_repeats(docs(spark, [(1, one), (2, two)])).collect()
    assert {(r["doc_id"], r["n_removed"], r["kept_text"]) for r in got} == {(1, 0, one), (2, 0, two)}
    rows = [(1, one), (2, two), (3, one), (4, f"x {two} y"), (5, "z " + tail)]
    got = substring_dedup.remove_repeats(docs(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_substrings(rows, 35)


def test_repeated_rows_spread_over_blocks(spark):
    rows = [(None, LONG[:4000])] * 64
    d, file, row = common.located(docs(spark, rows))
    assert d.select(F.xxhash64(file, row)).distinct().count() == 64
    assert {r["n_removed"] for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()} == {len(LONG[:4000].split())}


def test_window_hashes_modulo_a_prime():
    rng = np.random.default_rng(0)
    v, prime, base = rng.integers(0, 2**64, 9000, dtype=np.uint64), 2**61 - 1, common.BASES[1] % (2**61 - 1)
    for width in (1, 2, 3, 35, 64):
        got = common.window_hashes(v, width, base)
        assert len(got) == 9000 - width + 1
        for i in (0, 1, 8191, 8192, len(got) - 1):
            h = 0
            for x in v[i : i + width].tolist():
                h = (h * base + x) % prime
            assert h == got[i]
    assert len(common.window_hashes(v[:5], 6, base)) == 0


# ---------------------------------------------------------------------- exact


def brute_exact(rows):
    best, size = {}, {}
    for i, t in rows:
        k = lower(t)
        best[k] = i if best.get(k) is None else best[k] if i is None else max(best[k], i)
        size[k] = size.get(k, 0) + 1
    out = []
    for i, t in rows:  # of full ties one stays
        k = lower(t)
        out.append((i, best[k], size[k], i == best[k] and (k not in [lower(u) for j, u in rows[: len(out)] if j == i])))
    return sorted(out, key=repr)


MIXED = EDGE + [(10, "Hello World"), (11, "hello world"), (12, "HELLO world"), (13, "École"), (14, "école"), (15, "ÉCOLE"), (16, "écolE")]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_brute_force(spark, weak):
    # a digest of two values makes nearly every hit false: the full texts decide
    digest = (lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(2)).cast("string")) if weak else exact_dedup.sha256
    rows = [r for r in MIXED if not (weak and r[0] in (None,))]
    got = exact_dedup.dedup(docs(spark, rows), digest=digest, files_per_batch=1).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_exact(rows)


def test_exact_two_deliveries(spark, tmp_path):
    """A later call goes on from the state of an earlier one."""
    parts = [[(1, "one"), (5, "Two"), (3, "three")], [(2, "ONE"), (4, "two"), (6, "six"), (7, "SIX"), (8, "three")]]
    got = []
    for k, rows in enumerate(parts):
        docs(spark, rows).write.parquet(str(tmp_path / f"d{k}"))
        out = exact_dedup.dedup(spark.read.parquet(str(tmp_path / f"d{k}")), state=str(tmp_path / "state"))
        got.append(sorted(tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert got[0] == [(1, 1, 1, True), (3, 3, 1, True), (5, 5, 1, True)]
    assert got[1] == [(2, 2, 2, True), (4, 5, 2, False), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 2, True)]


def test_exact_hit_on_an_earlier_delivery_reads_its_bytes(spark, tmp_path):
    digest = lambda t: F.length(t).cast("string")
    for k, rows in enumerate([[(9, "aaa"), (1, "bbbb")], [(2, "ccc"), (3, "bbbb")]]):
        docs(spark, rows).write.parquet(str(tmp_path / f"d{k}"))
        out = exact_dedup.dedup(spark.read.parquet(str(tmp_path / f"d{k}")), digest=digest, state=str(tmp_path / "state"))
        got = sorted(tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept").collect())
    assert got == [(2, 2, 1, True), (3, 3, 2, True)]


def test_exact_hot_text(spark, tmp_path):
    """Rows of a text that very many share are not gathered by its digest."""
    docs(spark, [(k, "hot" if k % 3 else f"t{k}") for k in range(1500)]).repartition(6).write.parquet(str(tmp_path / "d"))
    got = exact_dedup.dedup(spark.read.parquet(str(tmp_path / "d"))).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_exact([(k, "hot" if k % 3 else f"t{k}") for k in range(1500)])


def test_exact_empty_table_and_settings(spark):
    before = {k: spark.conf.get(k, None) for k in exact_dedup.STORE}
    assert exact_dedup.dedup(docs(spark, [])).count() == 0
    assert {k: spark.conf.get(k, None) for k in exact_dedup.STORE} == before


# --------------------------------------------------------------------- mixing


def test_mixing_with_null_source(spark):
    rows = [(k, ("big", "mid", "small", None)[min(3, int(x))]) for k, x in enumerate(np.random.default_rng(1).exponential(0.8, 6000))]
    df = spark.createDataFrame([(i, s, "x", "y", "z") for i, s in rows], "doc_id long, source string, key string, _slot string, _block string")
    weights = {"big": 0.2, "mid": 0.5, "small": 0.25, None: 0.05}
    got = mixing.mix(df, weights, block=4).toPandas()
    assert sorted(got["doc_id"]) == list(range(6000))
    got["source"] = got["source"].fillna("none")
    assert worst_deviation(mixed_blocks(got), {k or "none": w for k, w in weights.items()}) < 1
    clash = mixing.mix(df, weights, block=4, carry=df.columns)
    assert clash.columns == [*df.columns, "_block_", "_slot_", "_place"] and clash.where("_slot = 'y'").count() == 6000


def test_mixing_repeated_ids_spread(spark, tmp_path):
    spark.createDataFrame([(None if k % 2 else 7, "a") for k in range(2000)], "doc_id long, source string").repartition(4).write.parquet(str(tmp_path / "d"))
    got = mixing.mix(spark.read.parquet(str(tmp_path / "d")), block=4)
    assert got.count() == 2000 and got.select("_slot", "_place").distinct().count() == 2000
    assert got.where("doc_id = 7").selectExpr("_slot div 100 AS part").distinct().count() == 5


def mixed_blocks(got):
    """Sources by slot, after checking that each slot holds one block of one source."""
    by = got.groupby("_slot").agg(lo=("source", "min"), hi=("source", "max"), b=("_block", "nunique"))
    assert (by["lo"] == by["hi"]).all() and (by["b"] == 1).all() and by.index.tolist() == list(range(len(by)))
    return by["lo"].tolist()


def worst_deviation(order, weights):
    """Largest distance of any source from its true share, after any slot of the whole schedule."""
    blocks = {s: order.count(s) for s in set(order)}
    ends = sorted(blocks, key=lambda s: blocks[s] / weights[s])
    at_v, at_t = [0.0], [0.0]
    for s in ends:
        v = blocks[s] / weights[s]
        at_v.append(v)
        at_t.append(sum(min(weights[x] * v, blocks[x]) for x in blocks))
    v = np.interp(np.arange(1, len(order) + 1), at_t, at_v)
    done = {s: np.cumsum([x == s for x in order]) for s in blocks}
    return max(np.abs(done[s] - np.minimum(weights[s] * v, blocks[s])).max() for s in blocks)


@pytest.mark.parametrize("weights", [{"a": 0.9, "b": 0.1}, {"a": 0.999, "b": 0.001}, {"a": 0.5, "b": 0.3, "c": 0.2}])
def test_schedule_of_100_000_slots(spark, weights):
    """Against the ideal mixture at every slot, without any slack."""
    sizes = [(k, round(100_000 * w), w) for k, w in enumerate(weights.values())]
    windows = mixing.block_windows(spark.createDataFrame(sizes, "sid long, blocks long, w double"))
    got = mixing.schedule(windows, len(sizes)).toPandas().sort_values("slot")
    assert got["slot"].tolist() == list(range(100_000))
    t = np.arange(1, 100_001)
    for sid, _, w in sizes:
        assert np.abs(np.cumsum(got["sid"].to_numpy() == sid) - w * t).max() < 1


@pytest.mark.parametrize("span", [64, mixing.SPAN])
def test_mixing_follows_the_true_weights(spark, span):
    weights = {"a": 0.2, "b": 0.4999, "c": 0.25, "d": 0.05, "e": 0.0001}
    sizes = {"a": 2400, "b": 5200, "c": 3000, "d": 900, "e": 20}
    rows = [(k, s) for k, s in enumerate(itertools.chain.from_iterable([s] * n for s, n in sizes.items()))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=2, span=span).toPandas()
    assert sorted(got["doc_id"]) == list(range(len(rows)))
    assert worst_deviation(mixed_blocks(got), weights) < 1


def test_mixing_hot_source_beside_many(spark):
    sizes = {"hot": 4000} | {f"s{k:02}": 100 + 7 * k for k in range(19)}
    rows = [(k, s) for k, s in enumerate(itertools.chain.from_iterable([s] * n for s, n in sizes.items()))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block=2).toPandas()
    assert worst_deviation(mixed_blocks(got), {s: n**0.5 for s, n in sizes.items()}) < 1


def test_mixing_many_sources(spark):
    sizes = {f"site{k:04}": 1 + k % 7 + 300 * (k == 9) for k in range(2500)}
    rows = [(k, s) for k, s in enumerate(itertools.chain.from_iterable([s] * n for s, n in sizes.items()))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block=4).toPandas()
    assert sorted(got["doc_id"]) == list(range(len(rows)))
    assert worst_deviation(mixed_blocks(got), {s: n**0.5 for s, n in sizes.items()}) < 1


def test_mixing_zero_weight_goes_last(spark):
    rows = [(k, "ab"[k % 2]) for k in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), {"a": 0.0, "b": 1.0}, block=4).toPandas()
    assert mixed_blocks(got) == ["b"] * 25 + ["a"] * 25


def test_ranges_of_slots_give_one_run(spark):
    rng = np.random.default_rng(5)
    sizes = [(i, int(n), float(w)) for i, (n, w) in enumerate(zip(rng.integers(1, 300, 9), rng.uniform(0.001, 1, 9)))]
    windows = mixing.block_windows(spark.createDataFrame(sizes, "sid long, blocks long, w double"))
    sent, left = mixing.earliest_first(windows.toPandas(), 0, sum(n for _, n, _ in sizes))
    got = sorted(tuple(r) for r in mixing.schedule(windows, 9, span=1).select("slot", "sid", "k").collect())
    assert left == [] and got == [(t, i, k) for t, (_, i, k) in enumerate(sent)]
    assert all(t < due for t, (due, _, _) in enumerate(sent))


def test_mixing_edges(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0
    one = mixing.mix(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id long, source string"))
    assert one.count() == 3


# ----------------------------------------------------------------- embeddings


def brute_vectors(rows, threshold=0.93):
    def ok(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = []
    for (a, (_, v, k)), (b, (_, w, m)) in itertools.combinations(enumerate(rows), 2):
        if ok(v, k) and ok(w, m) and k == m and len(v) == len(w):
            v, w = np.array(v, float), np.array(w, float)
            if v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links.append((a, b))
    g = groups(len(rows), links)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[g[k]] = min(least.get(g[k], i), i)
    n = np.bincount(np.array(links, int).ravel(), minlength=len(rows))
    return sorted((i, int(n[k]), least[g[k]]) for k, (i, _, _) in enumerate(rows))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "x") for i, v, k in rows], "vec_id long, embedding array<float>, label int, rep string")


def test_vectors_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 16)  # large filters fall into many cells
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 24)).astype(np.float32)
    rows = []
    for k in range(300):
        v = base[k % 30 if k % 3 else 0] + rng.normal(0, 0.12, 24).astype(np.float32)
        rows.append((1000 - k, [float(np.float32(x)) for x in v], int(k % 2)))
    rows += [(2000 + k, rows[5][1], rows[5][2]) for k in range(9)]
    rows += [(3000, None, 0), (3001, [0.0] * 24, 0), (3002, [float("nan")] * 24, 0), (3003, rows[0][1], None), (3004, [], 0), (3005, [1.0, None] * 12, 0), (3006, [1.0], 0), (3007, [2.0], 0), (3008, rows[0][1][:20], 0)]
    got = embedding_dedup.near_vectors(vectors(spark, rows)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_vectors(rows)
    assert embedding_dedup.near_vectors(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("words", [128, 512, 4096])
def test_filter_recall(words):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = rng.standard_normal((800, 64))
    n -= (n * x).sum(1, keepdims=True) * x
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    y = 0.93 * x + (1 - 0.93**2) ** 0.5 * n
    a, b = (set(zip(*(v.tolist() for v in embedding_dedup.decode(z, words)))) for z in (x, y))
    assert len({r for r, _ in a & b}) / 800 >= 0.98
    assert len(a) / 800 < 12 * words.bit_length()


def test_filters_follow_the_table(spark, monkeypatch):
    assert [embedding_dedup.code_size(n) for n in (0, 65_536, 65_537, 10**9, 10**12)] == [128, 128, 256, 16384, 16384]
    rows = [(k, np.random.default_rng(k % 40).standard_normal(16).tolist(), 0) for k in range(120)]
    got = []
    for words in (128, 1024):
        monkeypatch.setattr(embedding_dedup, "code_size", lambda n, words=words: words)
        got.append(sorted(map(tuple, embedding_dedup.near_vectors(vectors(spark, rows)).collect())))
    assert got[0] == got[1] and got[0][0][1] == 2


# -------------------------------------------------------------------- SimHash


def fingerprint(t):
    w = re.findall(SEP, lower(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(120):
        w = [f"t{x}" for x in np.random.default_rng(k % 12).integers(0, 999, 150)]
        for p in rng.integers(0, 150, k % 5):
            w[p] = "new"
        rows.append((500 - k, " ".join(w)))
    rows += [r for r in EDGE if r[0] is not None]
    fp = [fingerprint(t) for _, t in rows]
    g = groups(len(rows), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fp[a] ^ fp[b]).bit_count() <= 4])
    least = {}
    for k, (i, _) in enumerate(rows):
        least[g[k]] = min(least.get(g[k], i), i)
    got = simhash_dedup.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == sorted((i, fp[k], least[g[k]]) for k, (i, _) in enumerate(rows))
    assert len(set(least.values())) < len(rows) - 20
    assert simhash_dedup.near_duplicates(docs(spark, [])).count() == 0
    assert simhash_dedup.near_duplicates(docs(spark, EDGE)).count() == len(EDGE)


def test_small_trees_find_every_link(spark):
    rng = np.random.default_rng(5)
    fps = set()
    for b in rng.integers(0, 2**63, 60):
        for _ in range(8):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(k)
            fps.add(x)
    fp = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    g = groups(len(fp), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    root = dict(tuple(r) for r in components.connected(simhash_dedup.near_links(nodes, tree=8)).collect())
    got = [root.get(int(x), int(x)) for x in fp.view(np.int64)]
    assert len(set(zip(g, got))) == len(set(g)) == len(set(got))


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = dict(tuple(r) for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[k] for k in range(1, 41)} == {1} and {got[k] for k in range(100, 160)} == {100}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- classifiers


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


@pytest.mark.parametrize("module,f,label", [(toxicity, toxicity.toxicity, "toxic"), (quality, quality.quality, "quality")])
def test_classifier_edges(spark, module, f, label):
    good = "the weather was calm and the sea lay flat this morning number"
    rows = [(k, f"{good} {k}" if k % 2 else f"BUY BUY BUY trash moron trash {k} !!! trash moron") for k in range(200)] + [(1000 + k, t) for k, (_, t) in enumerate(EDGE)]
    clash = docs(spark, rows[:5], "_score string, id int, y long, label string, block string")
    known = labels(spark, [(k, k % 2, 1 - k % 2, "x") for k in range(150)] + [(160, None, None, "x"), (161, 7, 7, "x"), (3, 1, 0, "again")])
    got = {r["doc_id"]: r["_score"] for r in f(docs(spark, rows), known).collect()}
    assert len(got) == 200 + len(EDGE) and all(0 <= s <= 1 for s in got.values())
    right = [(got[k] >= 0.5) == (bool(k % 2) == (label == "quality")) for k in range(150, 200)]
    assert np.mean(right) > 0.95
    assert f(docs(spark, []), known).count() == 0
    assert f(clash, known, carry=clash.columns).columns == [*clash.columns, "_score_"]
    none = f(docs(spark, rows), known.where("false")).collect()
    assert {round(r["_score"], 6) for r in none} == {0.0}
    ones = f(docs(spark, rows), known.where(f"{label} = 1")).collect()
    assert {round(r["_score"], 6) for r in ones} == {1.0}


@pytest.mark.parametrize("name,label,least", [("op7_toxicity", "toxic", 0.97), ("op8_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    from tideline.llm import queries

    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(out) > 50
    assert (out["predicted"] == out[label]).mean() >= least
    rare = 1 if label == "toxic" else 0
    caught = (out["predicted"] == rare)[out[label] == rare]
    assert caught.sum() >= (4 if label == "toxic" else len(caught))  # the other two toxic ones hold none of the words that the label marks
    mod, rest = (5, 0) if label == "toxic" else (4, 2)
    assert all((zlib.crc32(str(i).encode()) % mod == rest) for i in out["doc_id"])


def test_log_count_ratios_and_scores_brute_force():
    texts, y = ["you fool", "fool fool", "nice day", "a nice walk", "calm", ""], np.array([1, 1, 0, 0, 0, 0])
    buckets = [set(toxicity.features(t).tolist()) for t in texts]
    ratio = toxicity.log_count_ratio([np.array(sorted(b), int) for b in buckets], y)
    for f in set().union(*buckets):
        p, q = (sum(f in b for b, k in zip(buckets, y) if k == x) + 1 for x in (1, 0))
        assert ratio[f] == pytest.approx(np.log((p / 4) / (q / 6)), rel=1e-5)
    model = toxicity.train(texts, y)
    m = np.frombuffer(model, np.float32)
    import pyarrow as pa

    for t, s in zip(texts, toxicity.score(model, pa.array(texts))):
        b = sorted(set(toxicity.features(t).tolist()))
        z = float(m[0]) + sum(float(m[1 + f]) for f in b) / max(1, len(b)) ** 0.5
        assert s == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)
    assert (toxicity.score(model, pa.array(texts)) >= 0.5).tolist() == [True, True, False, False, False, False]


def test_rare_class_is_learned():
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(300)]
    plain = [" ".join(rng.choice(words, 60)) for _ in range(200)]
    texts = [t + " scoundrel" if k < 12 else t for k, t in enumerate(plain)]
    import pyarrow as pa

    got = toxicity.score(toxicity.train(texts, np.array([1] * 12 + [0] * 188)), pa.array([" ".join(rng.choice(words, 60)) + x for x in (" scoundrel", "") for _ in range(20)]))
    assert (got[:20] >= 0.5).sum() >= 18 and (got[20:] >= 0.5).sum() <= 1


def test_training_sample_is_bounded_and_repeatable(spark):
    rows = docs(spark, [(k, f"t{k}") for k in range(300)] + [(5, "t5")] * 3)
    known = labels(spark, [(k, k % 2, 0, "x") for k in range(300)])
    one = labelled.training_rows(rows, known, "quality", "doc_id", "text", 4, 2, 20).collect()
    assert len(one) <= 40 and sorted(one) == sorted(labelled.training_rows(rows, known, "quality", "doc_id", "text", 4, 2, 20).collect())


# ------------------------------------------------------------------------ PII

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def brute_spans(text):
    out = []
    for kind, rule in BASE.items():
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            fits = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15)
            if fits:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


HARD = [
    "a@b.c_d@e.f x 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111-1111 1111 +1 (319) 555-5132) é🙂 me@x.org", "@@@ a@b a@b..c 1.1.1", "+1+2 333 444 5555", "00012.0.0.1 0256.1.1.1",
    "4111111111111111 4111-1111-1111-1112", "x" * 3000 + "@y.zz", "1" * 20_000 + " 9", "+12 ( 34 ) 567-8 90-", "1.2.3.4@5.6", "a.b@c.d@e.f", "0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0",
]


def test_base_spans_brute_force(spark):
    rng = np.random.default_rng(6)
    fuzz = ["".join(rng.choice(list("a1.@+- ()é9"), rng.integers(0, 60))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(HARD + fuzz)] + [(900 + k, t) for k, (_, t) in enumerate(EDGE)]
    found = pii.personal_data(docs(spark, rows)).select("doc_id", pii.written("base").alias("b"), pii.written("all").alias("a")).collect()
    got = {r["doc_id"]: r for r in found}
    assert {k: r["b"] for k, r in got.items()} == {k: brute_spans(t) for k, t in rows}
    for r in got.values():
        assert set(filter(None, r["b"].split(","))) <= set(filter(None, r["a"].split(",")))
    assert pii.personal_data(docs(spark, [])).count() == 0


def test_wider_spans_are_added(spark):
    rows = [(1, "call (212) 555-1234 now"), (2, "write to john [at] mail [dot] com"), (3, "order 212-555-9876x"), (4, "see me@x.org"), (5, "serial 4785380592391138")]
    rows += [(10 + k, "mail a@b.org or +49 30 1234567") for k in range(20)]
    got = {r["doc_id"]: r["a"] for r in pii.personal_data(docs(spark, rows)).select("doc_id", pii.written("all").alias("a")).collect()}
    assert got[1] == "phone:5:19" and got[2].startswith("email:9:") and got[4] == "email:4:12"
    assert got[3] == "" and got[5] == ""


def planted(rng, k):
    """(what stands before, the span, its kind or None if it is not personal data)."""
    pick, digit = (lambda *x: x[int(rng.integers(len(x)))]), lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    if k % 2:
        return (
            ("order ", f"{digit(3)}-{digit(3)}-{digit(4)}", None), ("serial ", next(d for d in iter(lambda: digit(16), 0) if not luhn(d)), None),
            ("version ", f"{rng.integers(256, 999)}.{digit(1)}.{digit(1)}.1", None), ("part ", f"1{digit(2)}-{digit(3)}-{digit(4)}x", None),
        )[k // 2 % 4]
    name, host = pick("ann", "bob.k", "carl_7"), pick("post", "uni7")
    return (
        (pick("", "email "), f"{name} [at] {host} [dot] {pick('com', 'de')}", "email"), (pick("", "write to "), f"{name}(at){host}.org", "email"),
        (pick("", "call "), f"({rng.integers(200, 999)}) {rng.integers(2, 9)}55-{digit(4)}", "phone"), (pick("", "client "), ":".join(["2001", "db8", *(f"{x:x}" for x in rng.integers(1, 65535, 6))]), "ip"),
        (pick("", "amex "), next(d for d in iter(lambda: "37" + digit(13), 0) if luhn(d)), "card"),
    )[k // 2 % 5]


def test_planted_spans_and_reliabilities(spark):
    """Precision and recall beyond the base rules, and what is estimated of the labelers
    against how often they are right."""
    rng, rows, true, false = np.random.default_rng(11), [], {}, set()
    for k in range(300):
        before, x, kind = planted(rng, k)
        text = f"the sea lay calm {before}{x} while we walked"
        at = text.index(x)
        rows.append((k, text))
        if kind:
            true[k] = f"{kind}:{at}:{at + len(x)}"
        else:
            false.add(k)
    rows += [(1000 + k, "mail a.b@c.org or dial +1 (743) 555-3824 today") for k in range(60)]
    df = docs(spark, rows)
    found = pii.personal_data(df).select("doc_id", pii.written("base").alias("b"), pii.written("all").alias("a")).collect()
    got = {r["doc_id"]: set(r["a"].split(",")) - set(r["b"].split(",")) - {""} for r in found}
    hit = sum(true[k] in got[k] for k in true)
    wrong = sum(len(v - {true.get(k)}) for k, v in got.items())
    assert hit >= 0.95 * len(true) and wrong <= 0.05 * hit
    found = common.stash(pii.candidates(df, "doc_id", "text"), "candidates")
    _, rates = pii.estimate(common.stash(pii.patterns(found), "patterns"))
    each = found.select("id", F.explode(F.concat(*[F.col(f"{a}_{k}") for a in ("base", "fail", "wide") for k in pii.KINDS])).alias("c"))
    each = each.select(F.col("id").isin(*false).alias("false"), *[F.col(f"c.{v}").alias(v) for v in pii.VOTES]).toPandas()
    for v in ("v_gazetteer", "v_context", "v_edges"):
        for side in (0, 1):
            part = each[v][each["false"] == bool(side)]
            for vote in (1, 0, -1):
                assert rates[v][side][vote] == pytest.approx((part == vote).mean(), abs=0.15), (v, side, vote)


# -------------------------------------------------------------------- packing


def test_cuts_are_optimal():
    rng = np.random.default_rng(7)
    for _ in range(200):
        cuts = np.cumsum(rng.integers(1, 8, rng.integers(1, 11)))
        extra = dict(zip(cuts.tolist(), rng.choice([0, 2.0, 5.0], len(cuts)).tolist()))
        got = packing.best_cuts(cuts, np.array(list(extra.values())), 8, True).tolist()

        def cost(c):  # the last window is not padded
            return sum(8 - (b - a) + extra[b] for a, b in zip(c[:-1], c[1:-1]))

        every = ([0, *x, int(cuts[-1])] for k in range(len(cuts)) for x in itertools.combinations(cuts[:-1].tolist(), k))
        assert cost(got) == pytest.approx(min(cost(c) for c in every if all(b - a <= 8 for a, b in zip(c, c[1:]))))


def check_packing(spark, df, rows, **options):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i if i is not None else -1, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows)
    got = packing.pack(df, **options).toPandas()
    got["doc_id"] = got["doc_id"].fillna(-1).astype(int)
    by_id = {}
    for i, ids in want:
        by_id.setdefault(i, []).append(ids)
    for i, pieces in got.groupby("doc_id"):
        for ids in by_id[i][:1]:
            for p in pieces.itertuples():
                assert zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 and 4 * p.doc_tokens == len(ids)
        assert pieces["length"].sum() == sum(len(x) // 4 for x in by_id[i])
    assert set(by_id) == set(got["doc_id"])
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq["offset"].to_numpy() == np.cumsum(seq["length"].to_numpy()) - seq["length"].to_numpy()).all()
        assert seq["length"].sum() <= options.get("capacity", 4096)
    return got


def test_packing_round_trip(spark):
    words = ["don't", "École!", "x́y", "naïve.", "<|endoftext|>", "ΣΑΣ", "a\u00a0b", "1234", "…", "İstanbul", "'s", "state-of-the-art", "🙂🙂", "ß", "ＡＢＣ"]
    rng = np.random.default_rng(8)
    rows = [(k, "".join(w + str(rng.choice([" ", "\n", ". "])) for w in rng.choice(words, rng.integers(0, 300)))) for k in range(60)]
    rows += [(100 + k, t) for k, (_, t) in enumerate(EDGE)] + [(None, "last one")]
    check_packing(spark, docs(spark, rows), rows)
    check_packing(spark, docs(spark, rows), rows, capacity=64, stretch=500)


def test_ids_of_words_with_equal_hashes(spark):
    rows = [(1, f"{thue_morse('a')} plain"), (2, f"{thue_morse('b')} plain"), (3, thue_morse("a")), (4, f"plain {thue_morse('b')} {thue_morse('a')}")]
    check_packing(spark, docs(spark, rows).coalesce(1), rows)
    check_packing(spark, docs(spark, rows).repartition(4), rows)


def test_repeated_ids_are_packed_by_several_tasks(spark, tmp_path):
    docs(spark, [(None, f"w{k} " * 40) for k in range(400)]).repartition(4).write.parquet(str(tmp_path / "d"))
    got = packing.pack(spark.read.parquet(str(tmp_path / "d")))
    assert got.selectExpr("sequence_id >> 32 AS task").distinct().count() == 4 and got.count() >= 400


def test_packing_pads_little_and_keeps_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    got = packing.pack(df).toPandas()
    n = got.groupby("sequence_id")["length"].sum()
    assert sum(0 if x & (x - 1) == 0 else 4096 - x for x in n) < 0.02 * n.sum()
    order = got.sort_values(["sequence_id", "offset"])["doc_id"].tolist()
    assert order == sorted(order)
    assert packing.pack(docs(spark, [])).count() == 0


# ------------------------------------------------------------------------ urls

URLS = [
    ("http://A.Example.NET/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"), ("https://b.net/q#z", "b.net", "/q", "net/", "block"),
    ("http://net/", "net", "/", "net/", "block"), ("http://x.net", "x.net", "", None, "allow"), ("ftp://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("http://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/", "block"), ("//nowhere/fr/", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("http://w.org/fr/a://b", "w.org", "/fr/a://b", "org/fr/", "allow"), ("http://?x", "", "", None, "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(k, u[0], None, "clash") for k, u in enumerate(URLS)], "page_id long, url string, html string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages).collect()}
    assert got == {k: u[1:] for k, u in enumerate(URLS)}
    assert url_filter.judge(pages.where("false")).count() == 0


HOSTS = [f"h{k}.io" for k in range(12)] + ["bad.net", "worse.net", "good.org"]


def linked_pages(spark):
    """The first four hosts link to blocked ones alone."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(300):
        h = HOSTS[int(rng.integers(0, len(HOSTS)))]
        to = rng.choice(["bad.net", "worse.net"] if h in HOSTS[:4] else HOSTS, rng.integers(0, 4))
        html = "".join(f"<A HREF = 'https://{t}/p'>x</A><a href=/local>" for t in to)
        rows.append((k, f"http://{h}/{'fr' if h == 'good.org' else 'p'}/{k}", html))
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_link_graph_against_sql(spark, tmp_path):
    import duckdb

    pages = linked_pages(spark)
    got = {tuple(r) for r in url_filter.judge(pages).collect()}
    pages.toPandas().to_parquet(tmp_path / "p.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/p.parquet'")
        assert got == set(db.execute(url_filter.SQL).fetchall())
    assert "good.org" not in {r[1] for r in got if r[4] == "block"}


def test_links_to_blocked_hosts_alone_block(spark):
    got = url_filter.judge(linked_pages(spark)).where("verdict = 'block'").select("host").distinct().collect()
    assert set(HOSTS[:4]) <= {r["host"] for r in got}


def test_many_linkers_and_chains(spark):
    """Thirty hosts that link to one blocked host alone are all blocked, half linkers not;
    the scores are those of the converged equations."""
    rows = [(0, "http://bad.net/", "")] + [(k, f"http://l{k}.io/", "<a href='http://bad.net/'>") for k in range(1, 31)]
    rows += [(40 + k, f"http://half{k}.io/", "<a href='http://bad.net/'><a href='http://l1.com/'>") for k in range(5)]
    rows += [(60, "http://far.io/", "<a href=http://half0.io>"), (61, "http://ring1.io/", "<a href=//ring2.io>"), (62, "http://ring2.io/", "<a href=//ring1.io>"), (63, "http://long.io/", "x" * 300_000 + "<a href=//bad.net>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["host"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    assert {h for h, v in got.items() if v == "block"} == {"bad.net", "long.io", *[f"l{k}.io" for k in range(1, 31)]}
    judged = pages.selectExpr("substring_index(substring_index(url, '/', 3), '/', -1) AS host", "html", "CASE WHEN url LIKE '%.net/%' THEN 'block' END AS verdict")
    rank = {r["host"]: r["distrust"] for r in url_filter.host_scores(judged).collect()}
    assert rank["bad.net"] == pytest.approx(0.15) and rank["l3.io"] == pytest.approx(0.15 * 0.85) and rank["half0.io"] == pytest.approx(0.15 * 0.85 / 2)
    assert rank["far.io"] == pytest.approx(0.15 * 0.85**2 / 2) and rank["ring1.io"] == 0


def test_digest_columns_are_sha256(spark):
    found = substring_dedup.op2_substring_dedup(spark, "/root/testdata/sf0.001").where("n_removed = 0").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("doc_id") == found["doc_id"]).first()["text"]
    assert found["kept_sha256"] == hashlib.sha256(" ".join(re.findall(SEP, text)).encode()).hexdigest()
