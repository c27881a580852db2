"""URL filters by rules and by propagation over the links between hosts.

Rules of a host (with its subdomains) and the beginning of a path judge the urls they fit; of
several the longest. What no rule fits is judged by its host. Hosts most of whose pages are
allowed by rules are trusted seeds, those most of whose pages are blocked are blocked seeds.
Trust is a personalised PageRank from the trusted seeds along the links; distrust is one from
the blocked seeds against them, since who links to blocked hosts is to blame. Each seed brings
a mass of one, so that a score means the same at any number of hosts. A host whose distrust is
above its trust by more than ``MARGIN`` is blocked, any other is allowed.

Both run in the same rounds, one join and one sum each. What n rounds leave out is at most the
damping to the power n of the mass, so their number follows from ``LEFT_OUT`` alone. Links are
summed per pair of hosts before they are shuffled; the links of a host with very many are dealt
over several parts, to each of which its mass is sent.

Urls that are null or lack ``://`` have an empty host and path; no rule fits them, no link
leads there, and they are allowed. Null or empty pages have no links. Rows that repeat are
judged alike. Links count once per page and host; those within a host do not count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from brightrow.llm.common import pick
from brightrow.session import durable, free

# Verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
LEFT_OUT = 0.01
MARGIN = 0.02
ROUNDS_PER_TABLE = 4
LINKS_PER_PART = 10_000
BROADCAST_BYTES = 32 * 1024 * 1024

AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Attributes with an address that names a host.
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\s]+)"""
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def host_of(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, where, begin in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(begin)
        name, verdict = F.when(fits, where + begin).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src``, ``dst`` and the number of pages of the one that link to the other, for different hosts."""
    named = pick(pages, url, html).where(F.col(html).contains("//"))
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)), lowered))
    links = named.select(host_of(F.col(url)).alias("src"), F.explode(targets).alias("dst"))
    return links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def seeds(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Per host: number of pages, and whether it is a trusted or a blocked seed."""
    urls = pick(pages, url).select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    _, verdict = rule_of(F.col("host"), F.col("path"), rules)
    counted = urls.where("host <> ''").select("host", verdict.alias("verdict")).groupBy("host").agg(
        F.count("*").alias("n_pages"),
        F.count_if(F.col("verdict") == "allow").alias("n_allowed"),
        F.count_if(F.col("verdict") == "block").alias("n_blocked"),
    )
    return counted.select(
        "host",
        "n_pages",
        (2 * F.col("n_allowed") > F.col("n_pages")).alias("trusted"),
        (2 * F.col("n_blocked") > F.col("n_pages")).alias("blocked"),
    )


def propagate(hosts: DataFrame, links: DataFrame, damping: float = DAMPING, left_out: float = LEFT_OUT) -> DataFrame:
    """host, trust and distrust of all hosts that a seed reaches, seeds included.

    ``hosts`` (host, trusted, blocked) has each host once, ``links`` (src, dst, n) each pair once.
    """
    ahead = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    back = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    both = ahead.unionByName(back)
    of_host = both.groupBy("kind", "host").agg(F.sum("n").alias("all"), F.count("*").alias("links"))
    of_host = durable(of_host.select("kind", "host", "all", F.ceil(F.col("links") / LINKS_PER_PART).alias("parts")))
    edges = durable(
        both.join(of_host, ["kind", "host"]).select(
            "kind",
            "host",
            F.pmod(F.xxhash64("to"), "parts").alias("part"),
            "to",
            (F.col("n") / F.col("all") * damping).alias("share"),
        )
    )
    source = [
        hosts.where(seed).select(F.lit(kind).alias("kind"), "host", F.lit(1 - damping).alias("mass"))
        for kind, seed in (("trust", "trusted"), ("distrust", "blocked"))
    ]
    start = durable(
        source[0].unionByName(source[1]).join(of_host, ["kind", "host"], "left").select(
            "kind", "host", "mass", F.coalesce("parts", F.lit(0)).alias("parts")
        )
    )
    # Hosts that are no seeds bring their parts only.
    known = start.unionByName(of_host.select("kind", "host", F.lit(0.0).alias("mass"), "parts"))
    state, old = start, None
    rounds = math.ceil(math.log(left_out) / math.log(damping)) if not edges.isEmpty() else 0
    for k in range(rounds):
        sent = state.where("mass > 0 AND parts > 0").withColumn(
            "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        )
        met = edges.join(sent.select("kind", "host", "part", "mass"), ["kind", "host", "part"])
        given = met.select("kind", F.col("to").alias("host"), (F.col("mass") * F.col("share")).alias("mass"), F.lit(0).cast("long").alias("parts"))
        state = known.unionByName(given).groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.max("parts").alias("parts"))
        if k % ROUNDS_PER_TABLE == ROUNDS_PER_TABLE - 1 or k == rounds - 1:
            state = durable(state)
            free(old)
            old = state
    score = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0))
    found = state.where("mass > 0").groupBy("host").agg(score("trust").alias("trust"), score("distrust").alias("distrust"))
    found = durable(found)
    free(edges, of_host, start, old)
    return found


def judge_pages(
    pages: DataFrame,
    page: str = "page_id",
    url: str = "url",
    html: str = "html",
    rules=RULES,
    margin: float = MARGIN,
    left_out: float = LEFT_OUT,
) -> DataFrame:
    """Per page: id, host, path, the rule that fits and the verdict, ``allow`` or ``block``."""
    links = durable(host_links(pages, url, html))
    hosts = seeds(pages, url, rules)
    scores = propagate(hosts, links, left_out=left_out)
    # Rounded, so that the order of a sum does not decide.
    beaten = F.round(F.col("distrust") - F.col("trust"), 9) > margin
    bad = durable(scores.where(beaten).select(F.col("host").alias("_bad")))
    free(links, scores)
    plain = pick(pages, page, url).toDF("_page", "_url")
    parts = plain.select("_page", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.select("_page", "host", "path", name.alias("rule"), verdict.alias("_verdict"))
    size = bad.agg(F.coalesce(F.sum(F.octet_length("_bad") + 32), F.lit(0)).alias("bytes")).first()["bytes"]
    met = judged.join(
        F.broadcast(bad) if size <= BROADCAST_BYTES else bad,
        (F.col("host") == F.col("_bad")) & F.col("_verdict").isNull(),
        "left",
    )
    said = F.coalesce("_verdict", F.when(F.col("_bad").isNotNull(), "block").otherwise("allow"))
    return met.select(F.col("_page").alias(page), "host", "path", "rule", said.alias("verdict"))


def pages_sql(damping: float = DAMPING, left_out: float = LEFT_OUT, margin: float = MARGIN, rules=RULES) -> str:
    """The same judgement as one statement over ``pages``; what n rounds give is the sum of n steps of a walk."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    lower = lambda text: f"translate({text}, '{CAPITALS}', '{SMALL}')"
    longest_first = sorted(rules, key=lambda r: -len(r[1]) - len(r[2]))

    def cases(value) -> str:
        fits = "(host = {0} OR ends_with(host, {1})) AND starts_with(path, {2})"
        return " ".join(
            f"WHEN {fits.format(quoted(h), quoted('.' + h), quoted(p))} THEN {quoted(value(v, h, p))}" for v, h, p in longest_first
        )

    rounds = math.ceil(math.log(left_out) / math.log(damping))
    return f"""
    WITH RECURSIVE u AS (
      SELECT page_id, html, {lower("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    p AS (SELECT *, CASE {cases(lambda v, h, p: h + p)} END AS rule, CASE {cases(lambda v, h, p: v)} END AS said FROM u),
    l AS (SELECT host AS src, unnest(list_distinct([{lower("x")} FOR x IN regexp_extract_all(html, {quoted(LINK)}, 1)])) AS dst FROM p),
    e AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
    m AS MATERIALIZED (
      SELECT 'trust' AS kind, src AS host, dst AS target, {damping} * n / sum(n) OVER (PARTITION BY src) AS share FROM e
      UNION ALL SELECT 'distrust', dst, src, {damping} * n / sum(n) OVER (PARTITION BY dst) FROM e),
    h AS (SELECT host, count(*) AS n, count(*) FILTER (said = 'allow') AS good, count(*) FILTER (said = 'block') AS bad
          FROM p WHERE host <> '' GROUP BY 1),
    t AS (
      SELECT 0 AS k, kind, host, mass FROM (
        SELECT 'trust' AS kind, host, 1 - {damping}::DOUBLE AS mass FROM h WHERE 2 * good > n
        UNION ALL SELECT 'distrust', host, 1 - {damping}::DOUBLE FROM h WHERE 2 * bad > n)
      UNION ALL
      SELECT t.k + 1, t.kind, m.target, sum(t.mass * m.share) FROM t JOIN m ON t.kind = m.kind AND t.host = m.host
      WHERE t.k < {rounds} GROUP BY t.k, t.kind, m.target),
    b AS (SELECT host FROM t GROUP BY 1
          HAVING round(sum(CASE kind WHEN 'distrust' THEN mass ELSE -mass END), 9) > {margin})
    SELECT page_id, host, path, rule,
           coalesce(said, CASE WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END) AS verdict FROM p
    """
