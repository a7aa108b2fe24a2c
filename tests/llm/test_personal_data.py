"""op9 beyond the base rules: forms that no pattern spells out, decoys, merging of spans."""

import time

import numpy as np

from tideline.llm import common, pii

from .test_operators import docs, luhn


def added(spark, rows):
    found = pii.personal_data(docs(spark, rows)).select("doc_id", pii.written("base").alias("b"), pii.written("all").alias("a")).collect()
    return {r["doc_id"]: set(r["a"].split(",")) - set(r["b"].split(",")) - {""} for r in found}


#: Forms by kind (None: not personal data); d, w and h stand for a digit, a word and a
#: hexadecimal group.
FORMS = [
    ("phone", "020 7dd6 0d5d"), ("phone", "0171-5d5 1d34"), ("phone", "(030) 90d82d"), ("phone", "0049 30 1d3 4d6"), ("phone", "0d1/234d6d8"), ("phone", "(02d) 4d5-6d8d"),
    ("email", "w AT w DOT org"), ("email", "w dot w at gmail dot com"), ("email", "w.w {at} w.de"), ("email", "w arroba w punto es"), ("email", "w @ w.net"), ("email", "w<at>w<dot>fr"),
    ("ip", "fe80::1h:feh:4567:h"), ("ip", "2001:db8::h"), ("ip", "2001:h::8a2e:h:7334"),
    (None, "2024-0d-1d"), (None, "1d.0d.19dd"), (None, "1 2dd 0dd"), (None, "1999-20dd"), (None, "looked at w.com"), (None, "stayed at w.org"), (None, "12:3d:4d"), (None, "3.141d9d6d"), (None, "978-3-16-148d1d-0"), (None, "order 1d3-4d6-7d9"),
]


def made(rng, form):
    """A form filled in, letter by letter where a placeholder stands alone."""
    words = "anna bob carl_7 dora.k erik".split()
    out = []
    for part in form.replace("<", " <").replace(">", "> ").split() if "<" in form else form.split(" "):
        for sign in ".":
            part = sign.join(str(rng.choice(words[:2])) if x == "w" else x for x in part.split(sign))
        if ":" in part:
            part = ":".join(x.replace("h", f"{rng.integers(16, 4095):x}"[: 4 - len(x) + 1]) for x in part.split(":"))
        elif any(c.isdigit() for c in part):
            part = "".join(str(rng.integers(1, 9)) if c == "d" else c for c in part)
        out.append(part)
    return ("" if "<" in form else " ").join(out)


def test_forms_that_no_pattern_spells_out(spark):
    """Precision and recall over the forms above, without words before that announce them."""
    rng, rows, true = np.random.default_rng(5), [], {}
    for k in range(20 * len(FORMS)):
        kind, form = FORMS[k % len(FORMS)]
        x = made(rng, form)
        text = f"the sea lay calm; {x} while we walked"
        at = text.index(x)
        rows.append((k, text))
        if kind:
            true[k] = f"{kind}:{at}:{at + len(x)}"
    rows += [(10_000 + k, "mail a.b@c.org or dial +1 (743) 555-3824 today") for k in range(60)]
    got = added(spark, rows)
    text = dict(rows)
    hit = sum(true[k] in got[k] for k in true)
    wrong = [(text[k], v) for k, v in got.items() if v - {true.get(k)}]
    lost = [(text[k], got[k]) for k in true if true[k] not in got[k]]
    assert hit >= 0.95 * len(true), lost[:20]
    assert len(wrong) <= 0.02 * hit, wrong[:20]


def test_merge_of_spans_against_all_pairs(spark):
    """Candidates clear of base spans and apart from each other, against comparing all pairs."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for doc in range(60):
        spots, n = [], int(rng.integers(0, 40 if doc else 1500))
        for _ in range(n):
            a = int(rng.integers(0, 6 * n))
            spots.append((a, a + int(rng.integers(1, 9)), 0, int(rng.choice([1, 0, -1])), 0, 0, 0, 0, int(rng.integers(0, 12))))
        rows.append((doc, spots))
        base = [s for s in spots if s[3] == 1]
        clear = [s for s in spots if s[3] != 1 and not any(s[0] < b[1] and b[0] < s[1] for b in base)]
        taken = []
        for s in sorted(clear, key=lambda s: (s[0], -s[1])):
            if not any(s[0] < t[1] and t[0] < s[1] for t in taken):
                taken.append(s)
        want[doc] = (sorted(s[:2] for s in clear), [s[:2] for s in taken])
    df = spark.createDataFrame(rows, f"doc_id long, spots {pii.SPOT}")
    df = common.stash(df, "spots")
    df = df.select("doc_id", pii.clear_of_base(df["spots"]).alias("clear"))
    got = {r["doc_id"]: r for r in df.select("doc_id", "clear", pii.apart(df["clear"]).alias("apart")).collect()}
    for doc, (clear, taken) in want.items():
        assert sorted((s["start"], s["end"]) for s in got[doc]["clear"]) == clear
        assert [(s["start"], s["end"]) for s in got[doc]["apart"]] == taken


UNITS = ["1 ", "dot a ", "a dot ", "(1", "a:", "::", " at a.", "1.", "a@", "(212) 555-1234, a@b.org, 10.1.1.1; "]


def test_long_texts_of_one_unit(spark):
    """No form of text makes the patterns or the merge take more than little over linear work."""
    took = []
    for n in (1_000, 40_000, 160_000):
        rows = common.stash(docs(spark, [(k, u * (n // len(u))) for k, u in enumerate(UNITS)]), "long")
        began = time.time()
        pii.candidates(rows, "doc_id", "text").write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[2] < 4 * took[1] + 10
