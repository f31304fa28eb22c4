r"""URL filter by link-graph propagation, in built-in functions only.

Rules name a host (with its subdomains) and a path prefix; the longest rule that fits a url decides it.  For
all other urls their host's standing decides: trust flows from hosts with allowed pages along links
(personalised PageRank), distrust from hosts with blocked pages against them.  A host's seed is the share of its pages that rules allow
(block); each step a node passes ``DAMPING`` percent of its score on in equal parts over its distinct
links and gets ``100 - DAMPING`` percent of its seed.  Beside each of both runs the PageRank in which every host has a full seed: what a
host receives of the first, relative to what it receives of the second, is the share of its inflow that comes from the seeds, whatever
the degrees of its neighbours.  A host's distrust (trust) is that share or the share of its own blocked (allowed) pages, if that is more; it is blocked if
its distrust exceeds its trust by more than ``THRESHOLD``, a half.  Scores are integers (``SCALE`` is 1), so sums don't depend on their order.

As many steps run as leave less than ``LEFT`` of the mass undelivered, whatever the graph, or fewer if nothing changes any more.

Links are absolute and protocol-relative ``href`` and ``src`` attributes; a page's relative links stay on its host and
are no edges.  The edge table has a row for each distinct pair of hosts, however many pages link.  Both propagations run
as one join and one aggregation per step; a host's links are dealt to slices of ``HUB``, so a hub's links are no hot key, and a step's
table is deleted after the next.

Cases: a url that is null or has no ``://`` has the empty host and path and, as no rule fits and no
score exists, is allowed.  Null html has no links.  Repeated rows are judged alike and each returned; each
counts in its host's shares.  Other columns are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolith.llm._store import cut, forget

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 10**10
DAMPING = 85
LEFT = 0.01
STEPS = math.ceil(math.log(LEFT) / math.log(DAMPING / 100))
#: Links of a host that one task may hold.
HUB = 100_000
#: A host of more than this share of the pages is heavy.
HEAVY = 1000
#: Trust and distrust are in these parts of 1.
PARTS = 10**6
THRESHOLD = PARTS // 2
#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(_after(url), r"\A[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules, what) -> Column:
    """``what(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(what((h, p, verdict)))).otherwise(out)
    return out


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct (src, dst) pairs of different hosts; ``pages`` has the column ``host``."""
    links = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), 1)).alias("link"))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    pairs = links.select(F.col("host").alias("src"), host_of(absolute).alias("dst")).where("src <> dst and dst <> ''")
    return pairs.groupBy("src", "dst").agg(F.lit(1).alias("n")).drop("n")


def propagate(edges: DataFrame, seeds: DataFrame, steps: int = STEPS, damping: int = DAMPING, hub: int = HUB) -> DataFrame:
    """(kind, host, score, received, even): the score after ``steps`` steps, from (src, dst) and (kind, host, seed), what of it was received, and what
    would have been if every host had a full seed.  Kind 0 flows along, kind 1 against the links.  Hosts without links have no row.
    """
    edges = cut(edges)
    if not edges.limit(1).count():
        return edges.selectExpr("0 as kind", "src as host", "0L as score", "0L as received", "0L as even")
    both = edges.selectExpr("0 as kind", "src as host", "dst as to").unionAll(edges.selectExpr("1 as kind", "dst as host", "src as to"))
    degree = cut(both.groupBy("kind", "host").agg(F.count(F.lit(1)).alias("degree")).withColumn("slices", F.ceil(F.col("degree") / hub)))
    flow = cut(both.join(degree.select("kind", "host", "slices"), ["kind", "host"]).withColumn("slice", F.pmod(F.xxhash64("to"), "slices")).drop("slices"))
    ends = degree.selectExpr("kind", "host", "degree", "slices", "0L as seed", "1 as linked").unionAll(flow.selectExpr("kind", "to as host", "0L as degree", "0L as slices", "0L as seed", "1 as linked"))
    nodes = ends.unionAll(seeds.selectExpr("kind", "host", "0L as degree", "0L as slices", "seed", "0 as linked")).groupBy("kind", "host")
    nodes = cut(nodes.agg(F.max("degree").alias("degree"), F.max("slices").alias("slices"), F.sum("seed").alias("seed"), F.max("linked").alias("linked")).where("linked = 1").drop("linked"))
    own = f"seed * {100 - damping} div 100"
    score = nodes.selectExpr("*", f"{own} as score", f"{SCALE * (100 - damping) // 100}L as base", "0L as received", "0L as even")
    before = None
    for _ in range(steps):
        give = score.where("degree > 0").selectExpr("kind", "host", "score div degree as s", "base div degree as b", "explode(sequence(0L, slices - 1)) as slice")
        passed = flow.join(give, ["kind", "host", "slice"]).selectExpr("kind", "to as host", "0L as degree", "0L as slices", "0L as seed", "s", "b")
        new = nodes.selectExpr("kind", "host", "degree", "slices", "seed", "0L as s", "0L as b").unionByName(passed).groupBy("kind", "host")
        new = new.agg(F.max("degree").alias("degree"), F.max("slices").alias("slices"), F.max("seed").alias("seed"), F.sum("s").alias("received"), F.sum("b").alias("even"))
        new = cut(new.selectExpr("kind", "host", "degree", "slices", "seed", f"{own} + received * {damping} div 100 as score", f"{SCALE * (100 - damping) // 100}L + even * {damping} div 100 as base", "received", "even"))
        now = new.agg(F.bit_xor(F.xxhash64("kind", "host", "received", "even"))).first()[0]
        if before is not None:
            forget(score)
        score = new
        if now == before:
            break
        before = now
    return score.select("kind", "host", "score", "received", "even")


def judge_urls(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", html: str = "html", steps: int = STEPS) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, trust, distrust (both in millionths)."""
    address = F.col(url)
    seen = pages.select(F.col(page_id).alias("page_id"), host_of(address).alias("host"), path_of(address).alias("path"), F.col(html).alias("html"))
    ruled = seen.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules, lambda r: r[0] + r[1])).withColumn("rule_verdict", matched_rule(F.col("host"), F.col("path"), rules, lambda r: r[2]))
    narrow = ruled.select("page_id", "host", "path", "rule", "rule_verdict")
    shares = narrow.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rule_verdict") == "allow").alias("good"), F.count_if(F.col("rule_verdict") == "block").alias("bad"))
    seeds = shares.selectExpr("0 as kind", "host", f"{SCALE}L * good div n as seed").unionAll(shares.selectExpr("1 as kind", "host", f"{SCALE}L * bad div n as seed"))
    part = f"cast(floor(try_divide(cast(received as double), even) * {PARTS}) as long)"
    passed = propagate(host_edges(seen, "html"), seeds, steps).where("even > 0").selectExpr("kind", "host", f"{part} as part")
    shared = seeds.selectExpr("kind", "host", f"seed div {SCALE // PARTS} as part").unionAll(passed)
    standing = cut(shared.groupBy("host").agg(F.coalesce(F.max(F.expr("if(kind = 0, part, null)")), F.lit(0)).alias("trust"), F.coalesce(F.max(F.expr("if(kind = 1, part, null)")), F.lit(0)).alias("distrust")))
    # hosts of over 1 / HEAVY of the pages are broadcast (fewer than HEAVY can be), so that they are no hot keys
    total = shares.agg(F.sum("n")).first()[0] or 0
    heavy = shares.where(F.col("n") * HEAVY > total).select("host")
    joined = narrow.join(F.broadcast(heavy.join(standing, "host", "left")), "host")
    rest = narrow.join(F.broadcast(heavy), "host", "left_anti").join(standing, "host", "left")
    out = joined.unionByName(rest).select("page_id", "host", "path", "rule", "rule_verdict", F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
    verdict = F.coalesce("rule_verdict", F.expr(f"if(distrust - trust > {THRESHOLD}L, 'block', 'allow')"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def judge_sql(steps: int = STEPS) -> str:
    """The same in DuckDB, steps written out."""
    rules = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    case = lambda pick: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick((h, p, v))}'" for h, p, v in rules) + " END"
    link = LINK.replace("'", "''")
    parts = [
        r"u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages)",
        rf"p0 AS (SELECT page_id, html, translate(regexp_extract(r, '\A[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '\A[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"p AS (SELECT page_id, html, host, path, {case(lambda r: r[0] + r[1])} AS rule, {case(lambda r: r[2])} AS rv FROM p0)",
        f"l AS (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM p WHERE host <> '')",
        r"l2 AS (SELECT host AS src, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS a FROM l)",
        rf"e AS (SELECT DISTINCT src, dst FROM (SELECT src, translate(regexp_extract(substr(a, instr(a, '://') + 3), '\A[^/?#]*', 0), '{UPPER}', '{LOWER}') AS dst FROM l2) WHERE src <> dst AND dst <> '')",
        "f AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY kind, host) AS degree FROM (SELECT 0 AS kind, src AS host, dst AS dest FROM e UNION ALL SELECT 1, dst, src FROM e))",
        "sh AS (SELECT host, count(*) AS n, count(*) FILTER (rv = 'allow') AS good, count(*) FILTER (rv = 'block') AS bad FROM p WHERE host <> '' GROUP BY 1)",
        f"b AS MATERIALIZED (SELECT 0 AS kind, host, {SCALE} * good // n AS seed FROM sh UNION ALL SELECT 1, host, {SCALE} * bad // n FROM sh)",
        "nd AS MATERIALIZED (SELECT kind, host, coalesce(seed, 0) AS seed FROM (SELECT kind, host FROM f UNION SELECT kind, dest FROM f) LEFT JOIN b USING (kind, host))",
        f"s0 AS MATERIALIZED (SELECT kind, host, seed * {100 - DAMPING} // 100 AS score, {SCALE * (100 - DAMPING) // 100} AS base, 0 AS received, 0 AS even FROM nd)",
    ]
    for k in range(1, steps + 1):
        parts.append(
            f"s{k} AS MATERIALIZED (SELECT kind, host, seed * {100 - DAMPING} // 100 + received * {DAMPING} // 100 AS score, {SCALE * (100 - DAMPING) // 100} + even * {DAMPING} // 100 AS base, received, even "
            f"FROM (SELECT kind, host, any_value(seed) FILTER (seed >= 0) AS seed, CAST(sum(s) AS BIGINT) AS received, CAST(sum(b) AS BIGINT) AS even "
            f"FROM (SELECT f.kind, f.dest AS host, -1 AS seed, score // degree AS s, base // degree AS b FROM f JOIN s{k - 1} s ON f.kind = s.kind AND f.host = s.host UNION ALL SELECT kind, host, seed, 0, 0 FROM nd) GROUP BY 1, 2))"
        )
    share = f"SELECT kind, host, seed // {SCALE // PARTS} AS part FROM b UNION ALL SELECT kind, host, CAST(floor(CAST(received AS DOUBLE) / even * {PARTS}) AS BIGINT) FROM s{steps} WHERE even > 0"
    st = f"st AS (SELECT host, coalesce(max(part) FILTER (kind = 0), 0) AS trust, coalesce(max(part) FILTER (kind = 1), 0) AS distrust FROM ({share}) GROUP BY 1)"
    return (
        "WITH " + ",\n".join([*parts, st]) + "\nSELECT page_id, p.host, path, rule, "
        f"coalesce(rv, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM p LEFT JOIN st ON p.host = st.host"
    )
