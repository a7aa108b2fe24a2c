"""The pipeline against a brute-force version, stage by stage."""

import itertools
import re

import pytest

import corpus_pipeline
from tests.llm.test_operators import SEP, fingerprint, groups, lower
from tideline.llm import mixing, packing, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage left, as Parquet."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_order_and_columns(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "source_mixing", "packing"]
    for docs in stages[:-1]:
        assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns


def test_each_stage(spark, stages):
    first = spark.read.parquet(f"{SF}/documents.parquet")
    scores = toxicity.op7_toxicity(spark, SF)
    kept = {r[0] for r in scores.where("predicted = 0").select("doc_id").collect()}
    rows = [tuple(r) for r in first.select("doc_id", "text").collect() if r[0] in kept]
    assert {r["doc_id"] for r in stages[0].collect()} == kept
    best = {}
    for i, t in rows:
        best[lower(t)] = max(best.get(lower(t), i), i)
    rows = [(i, t) for i, t in rows if best[lower(t)] == i]
    assert {r["doc_id"] for r in stages[1].collect()} == {i for i, _ in rows}
    rows.sort()
    fp = [fingerprint(t) for _, t in rows]
    g = groups(len(rows), [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if (fp[a] ^ fp[b]).bit_count() <= 4])
    rows = [r for k, r in enumerate(rows) if g[k] == k]
    assert {r["doc_id"] for r in stages[2].collect()} == {i for i, _ in rows}
    mixed = mixing.mix(stages[2]).orderBy("_slot", "_place").select("doc_id").collect()
    placed = stages[3].selectExpr("doc_id", "_metadata.file_name f", "_metadata.row_index r").orderBy("f", "r").collect()
    assert [r["doc_id"] for r in placed] == [r["doc_id"] for r in mixed]
    packed = stages[4].toPandas().sort_values(["sequence_id", "offset"])
    order = list(dict.fromkeys(packed["doc_id"].tolist()))
    assert order == [r["doc_id"] for r in mixed]
    assert packed.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY


def test_near_copies_of_repeated_ids(spark):
    """Rows are told apart by their text where an id is repeated."""
    clean, other, third = (" ".join(f"{w}{k}" for k in range(60)) for w in ("clean", "other", "third"))
    rows = [
        (1, "base text " * 40), (2, clean), (2, "BASE text " * 40),  # a copy of 1 under the id of a clean row
        (3, other), (3, other + " "),  # twice the smallest id in one class
        (4, third), (4, " ".join(f"fourth{k}" for k in range(60))),  # one id, two classes
        (5, "single " + "words here " * 30), (6, "SINGLE " + "words here " * 30), (None, third.upper()), (None, "null id one"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], lower(r["text"]).strip()) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    want = [rows[k] for k in (0, 1, 3, 5, 6, 7, 10)]
    assert sorted(got, key=repr) == sorted(((i, lower(t).strip()) for i, t in want), key=repr)


def test_copies_of_null_and_repeated_ids(spark):
    """An id that occurs with two texts loses only the row that is a copy."""
    plain, far = "base text " * 40, " ".join(f"far{k}" for k in range(60))
    rows = [(None, plain), (None, plain + " "), (None, far), (5, plain.upper()), (5, "own " + far.replace("far", "own")), (6, far), (6, far)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(got, key=repr) == sorted([rows[3], rows[4], rows[6]], key=repr)
    got = [tuple(r) for r in corpus_pipeline.drop_exact_copies(spark, docs, SF).collect()]
    assert sorted(got, key=repr) == sorted([rows[1], rows[3], rows[4], rows[6]], key=repr)


def test_columns_with_clashing_names(spark):
    names = ["_score", "_slot", "_place", "_block", "_file", "_row", "_t", "_digest", "_id", "fp", "locator", "kept", "digest", "_metadata"]
    rows = [(k, f"text number {k} of some", "s", *[f"{c}{k}" for c in names]) for k in range(12)]
    rows += [(50, rows[0][1].upper(), *rows[0][2:])]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"`{c}` string" for c in names]]))
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = sorted(tuple(r) for r in out.collect())
        assert set(got) <= set(rows) and len(got) == len(set(got)), name
        assert len(got) == {"exact_dedup": 12, "source_mixing": 13}.get(name, len(got)), name
    assert corpus_pipeline.pack_sequences(spark, docs, SF).count() >= 13


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in stages[-1].collect()}


def test_edges(spark):
    rows = [(1, None, "en", "a", 0), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "One two", "en", "a", 7), (4, "one TWO", "en", "a", 7), (5, "x " * 90_000, "en", "a", 9), (None, "zz", None, None, None)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string")
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, SF)
        out.collect()
        assert f(spark, docs.where("false"), SF).count() == 0
        if name == "exact_dedup":
            assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out.collect()) == [(False, 2), (False, 4), (False, 5), (True, None)]
    assert re.findall(SEP, "a b") == ["a", "b"]
