"""Personal data by weak supervision; DataFrame functions only.

Base rules find e-mail addresses, IP addresses, payment cards and phone numbers; these
spans always stay.  Candidates for more are matches of the base patterns that fail the
rule's check, and whatever is broadly of a kind's shape, true or not: words around an
at-token and dots, spelled out or not; groups of 7 to 15 (phone) or 13 to 19 (card) digits
with any separators; hexadecimal groups with colons.  Longer numbers are of no kind.
Candidates that touch a base span are left out.  Five labelers vote yes, no or nothing on
each candidate, base spans included:

* regex: yes to a base span, no to a match that fails its check, nothing on other forms;
* gazetteer: top-level domains, calling and area codes, issuer prefixes and check digits,
  reserved address ranges;
* form: layouts usual for the kind, or usual for something else (dates, thousands, years);
* context: words before it that announce the kind, or that announce something else;
* edges: what touches it on both sides.

Texts are read once.  Candidates go to the shared folder and are summed by kind, form
and votes, at most a thousand rows whatever the corpus.  Expectation-maximisation
over that table estimates the share of true candidates of each kind among usual and wide
forms, and how often each labeler says yes, no or nothing to true and to false ones.  It
starts from, and where votes are few stays near, ``BELIEF``; a failed check is never taken
for something that often happens to true ones.  The posteriors then train the final span
classifier, a naive Bayes over span features.  Candidates that it gives ``ADD`` or more
are added; where they overlap, the one that starts first, then the longer, then the first
kind.  Spans of a text are sorted and swept, in little more than linear work.

Offsets are code points, end exclusive.  Null text counts as empty and has no spans.
Text of any length is read whole.  Repeated rows get equal results; a null id is carried
along.  An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

KINDS = ("email", "ip", "card", "phone")
ADD, ROUNDS = 0.7, 12

#: The base rules, written so that no match is tried twice over (possessive
#: where the next character decides, and begun only where a run begins or a match ended).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # shorter groups of digits fail the rule anyway
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Spelled-out signs in the languages of the corpus; fixed values.
AT, DOT = "at|arroba|arobase", "dot|punto|point|punkt"
AT_SIGN = rf"(?: ?[\[({{<](?i:{AT}|@)[\])}}>] ?| (?i:{AT}) | ?@ ?)"
DOT_SIGN = rf"(?: ?[\[({{<](?i:{DOT}|\.)[\])}}>] ?| (?i:{DOT}) )"
#: What may be personal data beyond the base rules.  Again no stretch is tried twice over.
NUMBER = r"(?<![0-9A-Za-z+.,:/=#_-])(?=(?:[0-9(][ ()./-]{0,3}){6}[0-9])\(?[0-9]++(?:(?: [/-] |\)[ /-]{0,2}|[ /-]?\(|[ ./-])[0-9]++)*+(?![0-9A-Za-z])"
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])(?<!{DOT_SIGN})[A-Za-z0-9._%+-]++(?:{DOT_SIGN}[A-Za-z0-9._%+-]++)*+{AT_SIGN}[A-Za-z0-9-]++(?:(?:{DOT_SIGN}|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}+)?(?:::?[0-9A-Fa-f]{1,4}+){2,}+(?:::)?(?![0-9A-Za-z:])|(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}+::[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])",
    "card": NUMBER,
    "phone": NUMBER,
}
#: How many digits a wide number has, by kind.
DIGITS = {"card": (13, 19), "phone": (7, 15)}
#: Numbers that are no wider form: a card of the base rule, checked there; a bare number.
NOT_WIDE = {"card": r"^(?:[0-9][ -]?){15,18}[0-9]$", "phone": r"^[1-9][0-9]*$"}
#: A text without this holds no match of the kind (base, wide).
NEEDS = {
    "email": ("@", rf"{AT_SIGN}[A-Za-z0-9-]+(?:{DOT_SIGN}|\.)[A-Za-z0-9-]"),
    "ip": (r"[0-9]\.[0-9]", "[0-9A-Fa-f:]:[0-9A-Fa-f]{1,4}:|[0-9A-Fa-f]::[0-9A-Fa-f]"),
    "card": ("[0-9](?:[ -]?[0-9]){15}", "[0-9][0-9 ()./-]{11,}[0-9]"),
    "phone": (r"\+[0-9]", "[0-9][0-9 ()./-]{5,}[0-9]"),
}
#: Gazetteers and context words: fixed values.  A two-letter domain counts as a country's.
TOP_LEVEL = "com|org|net|edu|gov|mil|int|info|biz|name|pro|io|app|dev|cloud|online|site|shop|blog|email|tech|xyz|[a-z]{2}"
NOT_DOMAIN = "htm|html|php|jpg|png|gif|pdf|txt|doc|zip|exe|py|js|css|matrix"
CALLING = (
    r"(?:\+|00)(?:1|7|2[07]|2[1-689][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[789][0-9]|8[1246]|8[0578][0-9]|9[0-58]|9[679][0-9])"
)
#: First digits by the number of digits, and layouts.
ISSUER = r"^(?:3[47][0-9]{13}|3[068][0-9]{12}|4[0-9]{12}|(?:4|5[0-9]|2[2-7]|3[4-8]|6)[0-9]{14,17})$"
CARD_FORM = r"^(?:[0-9]{4}([ ./-])[0-9]{4}\1[0-9]{4}\1[0-9]{4,7}|[0-9]{4}([ ./-])[0-9]{6}\2[0-9]{4,5})$"
AREA = r"^\(?[2-9][0-9]{2}\)?[ ./-]*[2-9][0-9]{2}[ ./-]?[0-9]{4}$"
TRUNK = r"^\(?0[1-9]"
PHONE_FORM = r"^(?:\+|00|\([0-9]{2,5}\)|0[0-9]{2,4}[ /-])"
NOT_PHONE = (
    r"^[0-3]?[0-9]([./ -])[01]?[0-9]\1(?:[0-9]{2}|[12][0-9]{3})$|^[12][0-9]{3}([./ -])[01]?[0-9]\2[0-3]?[0-9](?:$|[ ].*)|^(?:1[5-9]|20)[0-9]{2}(?: ?[/-] ?| )(?:1[5-9]|20)[0-9]{2}"
    r"|^[1-9][0-9]{0,2}(?:[. ][0-9]{3})+$|^[0-9]+\.[0-9]+$|^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$|^97[89]"
)
IPV6 = r"(?i)^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$|^(?!.*::.*::)(?=(?:[^:]*:){2,7}[^:]*$)[0-9a-f:]*::[0-9a-f:]*$"
#: Words that stand before "at" in plain prose.
PROSE = r"(?i)^(?:look(?:s|ed|ing)?|meet|met|arriv(?:e|ed|es|ing)|stay(?:s|ed|ing)?|is|are|was|were|be|not|it|him|her|me|us|them|available|found|hosted|live|online|there|here|site|page|today|more|us) at "
RESERVED = r"^(?:0|10|127|22[4-9]|2[3-5][0-9])\.|^192\.168\.|^169\.254\.|^(?:0+:){7}"
WORDS_BEFORE = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|address|correo|courriel|adresse|schreib|escrib)[^\n]{0,24}$",
    "ip": r"(?i)(?:\bip|ipv[46]|host|server|address|client|login|logged|from|gateway|adresse)[^\n]{0,24}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|payment|paid|carte|tarjeta|karte)[^\n]{0,24}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|whatsapp|dial|ring|text|sms|telefon|appel|llam|anruf|handy)[^\n]{0,24}$",
}
OTHER_BEFORE = r"(?i)(?:isbn|issn|doi|order|invoice|version|release|serial|sku|part|build|ticket|ref|item|model|case|batch|page|tracking|account no|pedido|commande|bestell|looked|meet|arrived|stay|date|dated|since|between|year|isin|vat|total|sum|price)[^\n]{0,14}$"


SPOT = "array<struct<start:bigint,end:bigint,group:int,v_regex:int,v_gazetteer:int,v_form:int,v_context:int,v_edges:int,shape:int>>"
SPAN, STRETCH = "array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>", 256


def find(text: Column, pattern: str, need: str) -> Column:
    """Leftmost non-overlapping matches as structs start, end, hit, before, after: the
    pieces between matches and the matches themselves alternate, so lengths add up to offsets."""
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(SPAN)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["piece"])
        end = start + F.length(pair["hit"])
        found = F.struct(
            start.alias("start"),
            end.alias("end"),
            pair["hit"].alias("hit"),
            F.substring(pair["piece"], -40, 40).alias("before"),
            F.substring(pair["next"], 1, 8).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    pairs = F.arrays_zip(
        F.slice(pieces, F.lit(1), F.size(hits)).alias("piece"), hits.alias("hit"), F.slice(pieces, F.lit(2), F.size(hits)).alias("next")
    )

    def all_of(v: Column) -> Column:
        return fold(v, F.lit(0), SPAN, step)

    return F.when(text.rlike(need), let(pairs, all_of)).otherwise(none)


def fold(v: Column, begin: Column, kind: str, step) -> Column:
    """What ``step(state, element)`` gathers in state ``found`` (of type ``kind``), carrying the
    whole number ``at``.  It appends in stretches of ``STRETCH`` and joins those, so that an
    array of very many elements costs little more than its length."""
    none = F.array().cast(kind)

    def stretch(state: Column, first: Column) -> Column:
        start = F.struct(state["at"].alias("at"), none.alias("found"))
        part = F.aggregate(F.slice(v, first, F.lit(STRETCH)), start, step)
        return let(part, lambda p: F.struct(p["at"].alias("at"), F.concat(state["parts"], F.array(p["found"])).alias("parts")))

    empty = F.struct(begin.cast("bigint").alias("at"), F.array().cast(f"array<{kind}>").alias("parts"))
    parts = F.aggregate(F.sequence(F.lit(1), F.size(v), F.lit(STRETCH)), empty, stretch, lambda s: F.flatten(s["parts"]))
    return F.when(F.size(v) > 0, parts).otherwise(none)


def sweep(v: Column, begin: int, passes, after) -> Column:
    """The elements c with ``passes(at, c)``, where each makes ``at`` ``after(at, c)``."""

    def step(state: Column, c: Column) -> Column:
        ok, at, found = passes(state["at"], c), state["at"], state["found"]
        return F.struct(F.when(ok, after(at, c)).otherwise(at).alias("at"), F.when(ok, F.concat(found, F.array(c))).otherwise(found).alias("found"))

    return let(v, lambda w: fold(w, F.lit(begin), SPOT, step))


def basic(c: Column) -> Column:
    return c["v_regex"] == 1


def in_line(spots: Column) -> Column:
    """Sorted by start; base spans first, then the longer ones."""
    keyed = F.transform(spots, lambda c: F.struct(c["start"].alias("at"), (~basic(c)).alias("more"), (-c["end"]).alias("far"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda x: x["c"])


def clear_of_base(spots: Column) -> Column:
    """The candidates among ``spots`` that overlap no base span, sorted."""

    def before(at: Column, c: Column) -> Column:
        return basic(c) | (c["end"] <= at)

    def behind(at: Column, c: Column) -> Column:
        return basic(c) | (c["start"] >= at)

    # from the right: at is where the next base span starts; from the left: where the last one ended
    left = sweep(F.reverse(in_line(spots)), (1 << 62), before, lambda at, c: F.when(basic(c), F.least(at, c["start"])).otherwise(at))
    both = sweep(F.reverse(left), 0, behind, lambda at, c: F.when(basic(c), F.greatest(at, c["end"])).otherwise(at))
    return F.filter(both, lambda c: ~basic(c))


def apart(spots: Column) -> Column:
    """From left to right, those that overlap none taken before."""
    return sweep(in_line(spots), 0, lambda at, c: c["start"] >= at, lambda at, c: c["end"])


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def add(total: Column, k: Column) -> Column:
        d = number.substr(F.length(number) - k + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(k % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def valid(kind: str, hit: Column) -> Column:
    n = F.length(digits(hit))
    return {
        "email": F.lit(True),
        "ip": hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": F.when(n.between(16, 19), luhn(digits(hit))).otherwise(False),
        "phone": n.between(8, 15),
    }[kind]


def gazetteer(kind: str, hit: Column) -> Column:
    d = digits(hit)
    card = F.when(d.rlike(ISSUER), luhn(d)).otherwise(False)
    known = {
        "email": hit.rlike(rf"(?i)(?:\.|(?:{DOT})[\])}}>]? ?)(?:{TOP_LEVEL})$"),
        "ip": hit.contains(":") & hit.rlike(r"(?i)^(?:[23][0-9a-f]{3}|f[cde][0-9a-f]{2}):") | ~hit.contains(":"),
        "card": card,
        "phone": hit.rlike(rf"^{CALLING}") | hit.rlike(AREA) | hit.rlike(TRUNK) & F.length(d).between(9, 12),
    }[kind]
    strange = {
        "email": hit.rlike(rf"(?i)^[.]|(?:\.|(?:{DOT})[\])}}>]? ?)(?:{NOT_DOMAIN}|[0-9-]+)$"),
        "ip": hit.rlike(RESERVED) | hit.rlike(r"^[0-9]{1,2}:[0-9]{2}:[0-9]{2}$"),
        "card": ~card,
        "phone": hit.rlike(r"^\(?1[0-9]{2}\)?[ .-]|^[2-9][0-9]{2}[ .-][01][0-9]{2}[ .-][0-9]{4}$|^00"),
    }[kind]
    return F.when(known, 1).when(strange, 0).otherwise(-1) if kind in ("card", "phone") else F.when(strange, 0).when(known, 1).otherwise(-1)


def layout(kind: str, hit: Column) -> Column:
    """Vote of the form alone."""
    usual = {
        "email": hit.rlike(rf"@|[\[({{<](?i:{AT})[\])}}>]|(?i:{DOT})[\])}}> ]| AT "),
        "ip": ~hit.contains(":") | hit.rlike(IPV6),
        "card": hit.rlike(CARD_FORM),
        "phone": hit.rlike(PHONE_FORM),
    }[kind]
    unusual = {"email": hit.rlike(PROSE), "ip": ~hit.rlike(IPV6), "card": ~hit.rlike(rf"{CARD_FORM}|^[0-9]+$"), "phone": hit.rlike(NOT_PHONE)}[kind]
    return F.when(unusual, 0).when(usual, 1).otherwise(-1) if kind != "ip" else F.when(usual, 1).otherwise(0)


VOTES = ("v_regex", "v_gazetteer", "v_form", "v_context", "v_edges")
FEATURES = ("shape", "v_gazetteer", "v_form", "v_context", "v_edges")
#: What a candidate is: a match that fails its check, a base span, a wider form.
FAILED, BASIC, WIDER = 0, 1, 2
#: Chances of (yes, no) from a labeler on true and on false candidates to start with.
BELIEF = {
    "v_regex": ((0.70, 0.005), (0.02, 0.50)),
    "v_gazetteer": ((0.70, 0.05), (0.35, 0.35)),
    "v_form": ((0.70, 0.02), (0.15, 0.40)),
    "v_context": ((0.30, 0.02), (0.06, 0.35)),
    "v_edges": ((0.95, 0.05), (0.70, 0.30)),
}
#: The starting chances count as so many votes; bounds of what is estimated.
AS_VOTES, PRIORS, FAILS = 20.0, (0.05, 0.95), 0.01
GROUPS = range(2 * len(KINDS))


def describe(kind: str, c: Column, form: int) -> Column:
    """A candidate with its votes (1 yes, 0 no, -1 nothing) and features."""
    before, after, hit = c["before"], c["after"], c["hit"]
    touched = before.rlike(r"[\p{L}\p{N}_/=]$") | after.rlike(r"^[\p{L}\p{N}_/=]")
    context = F.when(before.rlike(OTHER_BEFORE), 0).when(before.rlike(WORDS_BEFORE[kind]), 1).otherwise(-1)
    return F.struct(
        c["start"].alias("start"),
        c["end"].alias("end"),
        F.lit(2 * KINDS.index(kind) + (form == WIDER)).alias("group"),
        F.lit({FAILED: 0, BASIC: 1, WIDER: -1}[form]).alias("v_regex"),
        gazetteer(kind, hit).alias("v_gazetteer"),
        layout(kind, hit).alias("v_form"),
        context.alias("v_context"),
        F.when(touched, 0).otherwise(1).alias("v_edges"),
        F.lit(3 * KINDS.index(kind) + form).alias("shape"),
    )


def of_kind(f, kind: str, field: str | None, *more):
    """A one-argument function for array functions: f(kind, element or its field, ...)."""
    return lambda c: f(kind, c[field] if field else c, *more)


def of_number(kind: str, hit: Column) -> Column:
    return F.length(digits(hit)).between(*DIGITS[kind]) & ~hit.rlike(NOT_WIDE[kind])


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and, for each kind, base spans, matches that fail the base rule, and wider forms;
    of the last two those that overlap no base span."""
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    numbers = find(F.col("text"), NUMBER, NEEDS["phone"][1])
    out = out.select(
        "id",
        *[find(F.col("text"), BASE[k], NEEDS[k][0]).alias(f"base_{k}") for k in KINDS],
        *[find(F.col("text"), WIDE[k], NEEDS[k][1]).alias(f"wide_{k}") for k in KINDS if k not in DIGITS],
        numbers.alias("numbers"),
    )
    described = {}
    for k in KINDS:
        fails = F.filter(f"base_{k}", of_kind(lambda kind, hit: ~valid(kind, hit) & (F.length(digits(hit)) < 20), k, "hit"))
        wide = F.filter("numbers", of_kind(of_number, k, "hit")) if k in DIGITS else F.col(f"wide_{k}")
        described[f"base_{k}"] = F.transform(F.filter(f"base_{k}", of_kind(valid, k, "hit")), of_kind(describe, k, None, BASIC))
        described[f"fail_{k}"] = F.transform(fails, of_kind(describe, k, None, FAILED))
        described[f"wide_{k}"] = F.transform(wide, of_kind(describe, k, None, WIDER))
    out = out.select("id", *[v.alias(c) for c, v in described.items()])
    more = F.concat(*[F.col(f"{a}_{k}") for a in ("fail", "wide") for k in KINDS])
    base = F.concat(*[F.col(f"base_{k}") for k in KINDS])
    free = F.when((F.size(more) > 0) & (F.size(base) > 0), clear_of_base(F.concat(base, more))).otherwise(more)
    out = out.select("id", *[f"base_{k}" for k in KINDS], free.alias("more"))

    def of_shape(shape: int) -> Column:
        return F.filter("more", lambda c: c["shape"] == shape)

    return out.select(
        "id",
        *[f"base_{k}" for k in KINDS],
        *[of_shape(3 * i + form).alias(f"{a}_{k}") for a, form in (("fail", FAILED), ("wide", WIDER)) for i, k in enumerate(KINDS)],
    )


def patterns(found: DataFrame) -> DataFrame:
    """How often each combination of votes and features occurs; a bounded table."""
    every = F.concat(*[F.col(f"{a}_{k}") for a in ("base", "fail", "wide") for k in KINDS])
    keys = list(dict.fromkeys(("group", *VOTES, *FEATURES)))
    return found.select(F.explode(every).alias("c")).groupBy(*[F.col(f"c.{k}").alias(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))


def chances(yes: float, no: float) -> dict[int, float]:
    return {1: yes, 0: no, -1: max(1e-3, 1 - yes - no)}


def start() -> tuple[dict, dict]:
    """(share of true candidates by group, {labeler: (chances if true, if false)})."""
    return {g: 0.5 for g in GROUPS}, {v: (chances(*t), chances(*f)) for v, (t, f) in BELIEF.items()}


def posterior(model: tuple[dict, dict]) -> Column:
    """Probability that a candidate is personal data, from its group and the votes."""
    priors, rates = model
    z = F.lit(0.0)
    for g, p in priors.items():
        z = z + F.when(F.col("group") == g, math.log(p / (1 - p))).otherwise(0.0)
    for v, (true, false) in rates.items():
        for vote in true:
            z = z + F.when(F.col(v) == vote, math.log(true[vote] / false[vote])).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def estimate(table: DataFrame, rounds: int = ROUNDS) -> tuple[dict, dict]:
    """Expectation-maximisation over the pattern table."""
    model, first = start(), start()[1]
    for _ in range(rounds):
        p = table.withColumn("p", posterior(model))
        mass = {0: F.col("n") * F.col("p"), 1: F.col("n") * (1 - F.col("p"))}
        sums = [F.coalesce(F.sum(F.when(F.col("group") == g, m)), F.lit(0.0)).alias(f"g{g}_{k}") for g in GROUPS for k, m in mass.items()]
        sums += [
            F.coalesce(F.sum(F.when(F.col(v) == vote, m)), F.lit(0.0)).alias(f"{v}{vote}_{k}") for v in VOTES for vote in (1, 0, -1) for k, m in mass.items()
        ]
        s = p.agg(*sums).first()
        priors = {g: min(PRIORS[1], max(PRIORS[0], (s[f"g{g}_0"] + 1) / (s[f"g{g}_0"] + s[f"g{g}_1"] + 2))) for g in GROUPS}
        rates = {}
        for v in VOTES:
            sides = []
            for k in (0, 1):
                total = sum(s[f"{v}{vote}_{k}"] for vote in (1, 0, -1)) + AS_VOTES
                sides.append({vote: max(1e-4, (s[f"{v}{vote}_{k}"] + AS_VOTES * first[v][k][vote]) / total) for vote in (1, 0, -1)})
            rates[v] = tuple(sides)
        rates["v_regex"][0][0] = min(FAILS, rates["v_regex"][0][0])
        model = priors, rates
    return model


def train(table: DataFrame, p: Column):
    """Naive Bayes on the posteriors: (intercept, {feature: {value: weight}})."""
    cells = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("int").alias("v")) for f in FEATURES])
    sums = (
        table.withColumn("p", p)
        .select("n", "p", F.explode(cells).alias("c"))
        .groupBy("c.f", "c.v")
        .agg(F.sum(F.col("n") * F.col("p")).alias("t"), F.sum(F.col("n") * (1 - F.col("p"))).alias("u"))
        .collect()
    )
    one = [r for r in sums if r["f"] == "v_edges"]
    t, u = sum(r["t"] for r in one), sum(r["u"] for r in one)
    weights: dict[str, dict[int, float]] = {f: {} for f in FEATURES}
    for r in sorted(sums):
        weights[r["f"]][r["v"]] = math.log((r["t"] + 1) / (t + 4)) - math.log((r["u"] + 1) / (u + 4))
    return math.log((t + 1) / (u + 1)), weights


def probability(model, c: Column) -> Column:
    intercept, weights = model
    z = F.lit(intercept)
    for f, w in weights.items():
        term = F.lit(0.0)
        for v, x in w.items():
            term = F.when(c[f] == v, x).otherwise(term)
        z = z + term
    return 1 / (1 + F.exp(-z))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, and for each kind the arrays base_<kind> and
    all_<kind> of structs start, end, by start."""
    found = C.stash(candidates(docs, id_col, text_col), "candidates")
    table = C.stash(patterns(found), "vote-patterns")
    model = train(table, posterior(estimate(table)))

    def span(c: Column) -> Column:
        return F.struct(c["start"].alias("start"), c["end"].alias("end"))

    def good(c: Column) -> Column:
        return probability(model, c) >= ADD

    more = F.filter(F.concat(*[F.col(f"{a}_{k}") for a in ("fail", "wide") for k in KINDS]), good)
    taken = F.when(F.size("more") > 0, apart(F.col("more"))).otherwise(F.col("more"))
    out = found.select("id", *[f"base_{k}" for k in KINDS], more.alias("more")).withColumn("more", taken)

    def of_this(kind: str, c: Column) -> Column:
        return F.floor(c["shape"] / 3) == KINDS.index(kind)

    return out.select(
        F.col("id").alias(id_col),
        *[F.transform(f"base_{k}", span).alias(f"base_{k}") for k in KINDS],
        *[F.array_sort(F.transform(F.concat(f"base_{k}", F.filter("more", of_kind(of_this, k, None))), span)).alias(f"all_{k}") for k in KINDS],
    )


def written(prefix: str) -> Column:
    """kind:start:end, by kind and start, comma-joined."""

    def say(kind: str, c: Column) -> Column:
        return F.concat_ws(":", F.lit(kind), c["start"].cast("string"), c["end"].cast("string"))

    each = [F.transform(f"{prefix}_{k}", of_kind(say, k, None)) for k in KINDS]
    return F.array_join(F.concat(*each), ",")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(C.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(written("base"), 256).alias("base_sha256"),
        written("all").alias("spans"),
    )
