"""URL verdicts from rules, and from trust and distrust propagated over the host graph.

Rules judge the urls they fit.  For the rest, hosts are judged: personalised
PageRank flows from trusted hosts along links, distrust from blocked hosts
against them (who links to a blocked host is suspect).  A host is blocked if its
distrust passes its trust and enough of its own links lead to blocked hosts.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: verdict, host and path prefix; the production rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls.  Rules are a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts, counted."""
    to = F.explode(F.array_distinct(F.regexp_extract_all(F.col("html"), F.lit(LINK), 1)))
    found = pages.select(host_of(F.col("url")).alias("src"), to.alias("to")).select("src", lower_ascii(F.col("to")).alias("dst"))
    return found.filter("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, rounds: int = 12, cut_every: int = 4) -> DataFrame:
    """``kind, host, score`` after ``rounds`` steps from ``seeds(kind, host, seed)``.

    Kind ``trust`` follows ``edges``, kind ``distrust`` goes against them; a
    host shares its score among its links by their counts.  Kind ``leads`` goes
    against them too, but whole: a host takes from each it links to by the share
    of its own links.  Mass at hosts without a way on is lost.  Lineage is cut
    every few rounds.
    """
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").union(
        edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "n")
    )
    total = both.groupBy("kind", "a").agg(F.sum("n").alias("all"))
    ways = cut(both.join(total, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("all")).alias("w")), "ways")
    leads = ways.filter("kind = 'trust'").select(F.lit("leads").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), "w")
    ways = ways.union(leads)
    start = cut(seeds, "seeds")
    score = start.select("kind", "host", F.col("seed").alias("score"))
    if not ways.take(1):  # nothing flows
        return score.withColumn("score", F.col("score") * (1 - damping))
    for k in range(rounds):
        held = score.select(F.col("kind").alias("_kind"), F.col("host").alias("_host"), "score")
        moved = held.join(ways, (F.col("kind") == F.col("_kind")) & (F.col("a") == F.col("_host"))).select(
            "kind", F.col("b").alias("host"), (F.col("score") * F.col("w") * damping).alias("part")
        )
        born = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("part"))
        score = moved.union(born).groupBy("kind", "host").agg(F.sum("part").alias("score"))
        if (k + 1) % cut_every == 0:
            score = cut(score, "rank")
    return score


def host_verdicts(pages: DataFrame, judged: DataFrame, *, floor: float = 1e-6, **how) -> DataFrame:
    """``host, trust, distrust, leads, blocked``; only hosts that any score reaches.

    Seeds are hosts most of whose pages a rule allows, or blocks; each kind's
    seeds share a mass of one.  Distrust thins out with the number of seeds and
    of hosts that link to one, so ``floor`` is held against ``leads``: from one
    at every blocked seed, the damped share of a host's links that lead there,
    which the rest of the graph doesn't change.  ``leads`` is rounded and scores
    are compared with a margin, so their order of addition can't change a verdict.
    """
    share = judged.filter("host <> ''").groupBy("host").agg(
        F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"), F.count(F.lit(1)).alias("n")
    )
    seeds = (
        share.select("host", F.explode(F.array(
            F.struct(F.lit("trust").alias("kind"), F.col("good").alias("own")), F.struct(F.lit("distrust").alias("kind"), F.col("bad").alias("own"))
        )).alias("s"), "n")
        .filter("s.own * 2 > n")
        .select(F.col("s.kind").alias("kind"), "host")
    )
    seeds = cut(seeds, "seed-hosts")
    count = seeds.groupBy("kind").agg(F.count(F.lit(1)).alias("all"))  # two rows
    whole = seeds.filter("kind = 'distrust'").select(F.lit("leads").alias("kind"), "host", F.lit(1.0).alias("seed"))
    seeds = seeds.join(F.broadcast(count), "kind").select("kind", "host", (F.lit(1.0) / F.col("all")).alias("seed")).union(whole)
    score = propagate(host_edges(pages), seeds, **how)
    by = score.groupBy("host").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust", "leads")]
    )
    return by.withColumn("blocked", (F.round("leads", 12) > floor) & (F.col("distrust") > F.col("trust") * (1 + 1e-9)))


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, **how) -> DataFrame:
    """``page_id, host, path, rule, verdict, by`` for every row of ``pages``.

    ``rule`` is null where none fits; then ``verdict`` is the host's, ``allow``
    unless propagation blocks it.  A null url, or one without ``://``, has an
    empty host and path, fits no rule and is allowed.  Null html has no links.
    Rows repeat as they do in ``pages``; columns of ``pages`` other than page_id,
    url and html are not looked at, whatever they are called.  Empty table: empty.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, ruled = fitting(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), ruled.alias("ruled"))
    hosts = cut(host_verdicts(pages, judged, **how).filter("blocked").select(F.col("host").alias("_host")), "blocked-hosts")
    return judged.join(hosts, F.col("rule").isNull() & (F.col("host") == F.col("_host")), "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("_host").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").otherwise("host").alias("by"),
    )


def op4_query(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("by")


def _oracle(rounds: int = 12, damping: float = 0.85) -> str:
    cases = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    fit = [
        (f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}')", what, text)
        for what, text in cases
        for own, _, rest in [text.partition("/")]
    ]
    rule = " ".join(f"WHEN {c} THEN '{text}'" for c, _, text in fit)
    ruled = " ".join(f"WHEN {c} THEN '{what}'" for c, what, _ in fit)
    link = LINK.replace("'", "''")
    steps = "".join(
        f"""
, s{k + 1} AS (
  SELECT kind, host, sum(part) AS score FROM (
    SELECT w.kind, b AS host, score * w * {damping}::DOUBLE AS part FROM s{k} JOIN ways w ON w.kind = s{k}.kind AND a = host
    UNION ALL SELECT kind, host, seed * (1 - {damping}::DOUBLE) FROM seeds) GROUP BY kind, host)"""
        for k in range(rounds)
    )
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, html, coalesce(rest, '') AS rest FROM u)
), j AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {ruled} END AS ruled FROM p),
share AS (SELECT host, count(*) FILTER (WHERE ruled = 'allow') AS good, count(*) FILTER (WHERE ruled = 'block') AS bad, count(*) AS n FROM j WHERE host <> '' GROUP BY host),
sh AS (SELECT 'trust' AS kind, host FROM share WHERE good * 2 > n UNION ALL SELECT 'distrust', host FROM share WHERE bad * 2 > n),
seeds AS (SELECT kind, host, 1::DOUBLE / count(*) OVER (PARTITION BY kind) AS seed FROM sh),
t AS (SELECT host AS src, translate(x, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS dst FROM (SELECT host, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS x FROM p)),
e AS (SELECT src, dst, count(*) AS n FROM t WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
ways AS (
  SELECT kind, a, b, n::DOUBLE / sum(n) OVER (PARTITION BY kind, a) AS w
  FROM (SELECT 'trust' AS kind, src AS a, dst AS b, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e)
), s0 AS (SELECT kind, host, seed AS score FROM seeds){steps}
, h AS (
  SELECT host, round(coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0), 12) AS trust, round(coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0), 12) AS distrust
  FROM s{rounds} GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust > 1e-6 AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN h USING (host)
"""


ORACLE = _oracle()
