"""URL filters: rules first, link-graph propagation for the rest; DataFrame functions only.

A rule fits its host and all subdomains if the path starts with the rule's; the longest
wins.  For pages without a rule, hosts are scored over the graph of links between hosts
(absolute href targets in the pages' html, summed by pair of hosts):

* trust: personalised PageRank along links, restarted at hosts in the share of their
  pages that an allow rule fits; a host hands its trust on in equal parts of its links;
* distrust: the reverse, restarted at hosts in the share of their pages that a block rule
  fits; a host takes on the distrust of the hosts it links to, each in the share of its own
  links.  So what counts is how much of a host's linking goes to blocked hosts, not how
  many others link there too.

A host is blocked where distrust exceeds trust by more than ``THRESHOLD`` of a restart
at full share: about 59 % of its links going to wholly blocked hosts that link no further,
if nothing else is known.  Otherwise, and without any evidence, it is allowed.  Rounds go
on until the scores' summed change over ``STEP`` rounds is under ``CHANGE`` of the sum of
all restarts, or ``ROUNDS`` are done.  Hosts are joined by key and contributions summed
before each shuffle; every ``STEP`` rounds go to the shared folder.  Links inside a host
are left out.

Null urls and urls without ``://`` have empty host and path, fit no rule and are allowed.
Null html has no links.  Repeated rows are judged alike and count as pages.  Other
columns are carried by nobody: the result has the id and the judgement.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .exact_dedup import LOWER, UPPER

#: Fixed values of the query: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING, THRESHOLD = 0.85, 0.5
ROUNDS, STEP, CHANGE = 45, 5, 1e-3
LINK = r"""(?i)href[ \t\r\n]*=[ \t\r\n]*["']?(?:https?:)?//([^/?#"' \t\r\n>]+)"""


def parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule, or null."""
    tests = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        tests.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*tests, F.lit(None).cast("string"))


def host_scores(judged: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from pages with host, verdict by rule (or null) and html."""
    spark = judged.sparkSession
    seeds = judged.where("host <> ''").groupBy("host").agg(
        F.avg(F.when(F.col("verdict") == "allow", 1.0).otherwise(0.0)).alias("s_trust"),
        F.avg(F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)).alias("s_distrust"),
    )
    targets = F.when(F.contains("html", F.lit("//")), F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))
    pairs = (
        judged.where("host <> ''")
        .select("host", F.explode(targets).alias("to"))
        .select("host", F.translate("to", UPPER, LOWER).alias("to"))
        .where("host <> to")
        .groupBy("host", "to")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = C.stash(pairs, "host-links")
    out = pairs.groupBy("host").agg(F.sum("n").alias("n_out"))
    edges = C.stash(pairs.join(out, "host").select("host", "to", (F.col("n") / F.col("n_out")).alias("p")), "host-edges")
    hosts = seeds.join(edges.select("host").union(edges.select("to")).distinct(), "host", "full").fillna(0.0)
    seeds = C.stash(hosts, "host-seeds")
    ranks = seeds.select("host", *[(F.col(f"s_{c}") * (1 - damping)).alias(c) for c in ("trust", "distrust")])
    if edges.isEmpty():
        return ranks
    enough = CHANGE * ranks.agg(F.sum(F.col("trust") + F.col("distrust")).alias("s")).first()["s"]
    for _ in range(0, rounds, STEP):
        before, now = ranks, ranks
        for _ in range(STEP):
            now = one_round(seeds, edges, now, damping)
        ranks = C.stash(now, "host-ranks")
        was = before.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
        change = ranks.join(was, "host").agg(F.sum(F.abs(F.col("trust") - F.col("t")) + F.abs(F.col("distrust") - F.col("d"))).alias("s"))
        if change.first()["s"] <= enough:
            break
    return ranks


def one_round(seeds: DataFrame, edges: DataFrame, ranks: DataFrame, damping: float) -> DataFrame:
    ahead = edges.join(ranks.select("host", "trust"), "host").select(
        F.col("to").alias("host"), (F.col("trust") * F.col("p")).alias("trust"), F.lit(0.0).alias("distrust")
    )
    back = edges.join(ranks.select(F.col("host").alias("to"), "distrust"), "to").select(
        "host", F.lit(0.0).alias("trust"), (F.col("distrust") * F.col("p")).alias("distrust")
    )
    given = ahead.unionByName(back).groupBy("host").agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d"))
    return seeds.join(given, "host", "left").select(
        "host",
        (F.col("s_trust") * (1 - damping) + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
        (F.col("s_distrust") * (1 - damping) + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
    )


def judge(
    pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict."""
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    rows = rows.withColumn("rule", fitting(F.col("host"), F.col("path"), rules))
    by_rule = reduce(lambda c, r: c.when(F.col("rule") == r[0], r[1]), rules, F)
    rows = rows.withColumn("verdict", by_rule)
    scores = host_scores(rows)
    bad = scores.where(f"distrust - trust > {THRESHOLD * (1 - DAMPING) + 1e-9!r}").select("host", F.lit("block").alias("own"))
    # blocked hosts without any page of their own are nobody's verdict
    open_pages = rows.select("id", "host", "path", "rule", "verdict")
    return open_pages.join(bad, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", "own", F.lit("allow")).alias("verdict")
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "pages"))


def _sql() -> str:
    tests = []
    for rule, verdict in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        tests.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{start}') THEN ")
    ordered = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    rule = "CASE " + " ".join(f"{t}'{r}'" for t, (r, _) in zip(tests, ordered)) + " END"
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES) + " END"
    link = LINK.replace("'", "''")
    sql = f"""
WITH rest AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), part AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest
), ruled AS (SELECT *, {rule} AS rule FROM part),
judged AS (SELECT *, {verdict} AS verdict FROM ruled),
own AS (
  SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS s_t,
         avg(CASE WHEN verdict = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS s_d
  FROM judged WHERE host <> '' GROUP BY host
), link AS (
  SELECT host, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM judged WHERE host <> ''
), pair AS (SELECT host, dst, count(*) AS n FROM link WHERE host <> dst GROUP BY ALL),
edge AS (
  SELECT host, dst, n / sum(n) OVER (PARTITION BY host) AS p FROM pair
), node AS (SELECT host FROM own UNION SELECT host FROM edge UNION SELECT dst FROM edge),
seed AS (SELECT host, coalesce(s_t, 0) AS s_t, coalesce(s_d, 0) AS s_d FROM node LEFT JOIN own USING (host)),
r0 AS (SELECT host, s_t * {1 - DAMPING!r} AS t, s_d * {1 - DAMPING!r} AS d FROM seed)"""
    for k in range(ROUNDS):
        sql += f""",
r{k + 1} AS MATERIALIZED (
  SELECT seed.host, s_t * {1 - DAMPING!r} + {DAMPING} * coalesce(f.t, 0) AS t, s_d * {1 - DAMPING!r} + {DAMPING} * coalesce(b.d, 0) AS d
  FROM seed
  LEFT JOIN (SELECT dst AS host, sum(t * p) AS t FROM edge JOIN r{k} USING (host) GROUP BY dst) f USING (host)
  LEFT JOIN (SELECT edge.host, sum(d * p) AS d FROM edge JOIN r{k} ON r{k}.host = edge.dst GROUP BY edge.host) b USING (host)
)"""
    return sql + f"""
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN d - t > {THRESHOLD * (1 - DAMPING) + 1e-9!r} THEN 'block' END, 'allow') AS verdict
FROM judged LEFT JOIN r{ROUNDS} USING (host)
"""


SQL = _sql()
