"""URL filters against plain rules and a plain power iteration."""

import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from brightrow.llm import links

PAGES = "page_id long, url string, html string"


def page(*targets, quote='"'):
    return "<html>" + "".join(f"<a class=x href={quote}{t}{quote}>x</a>" for t in targets) + "</html>"


def web(rng, size):
    """Pages of hosts that link by habit: good to good, a farm to blocked hosts, some to both."""
    good = [f"www.good{i}.example.com" for i in range(6)]
    plain = [f"plain{i}.example.org" for i in range(8)]
    farm = [f"farm{i}.example.org" for i in range(5)]
    bad = [f"bad{i}.example.net" for i in range(3)]
    rows = []
    for i in range(size):
        host = rng.choice(good + plain + farm + bad)
        path = "/es/1" if host in bad else rng.choice(("/en/1", "/de/2?x#y", "", "/"))
        near = good + plain if host in good or host in plain else bad + farm
        picked = rng.sample(near, rng.randint(0, 4)) + (rng.sample(good + bad, 1) if rng.random() < 0.1 else [])
        targets = [rng.choice(("http://", "https://", "//", "HTTP://")) + rng.choice((h, h.upper())) + "/a" for h in picked]
        rows.append((i, f"https://{host}{path}", page(*targets, "/inside", "#top", quote=rng.choice(('"', "'")))))
    return rows


AWKWARD = [
    (900, None, page("http://plain0.example.org")),
    (901, "no scheme", None),
    (902, "", ""),
    (903, "://", page("//x.example.org")),
    (904, "HTTP://WWW.Example.COM/EN/a", ""),
    (905, "http://www.example.com/en/a?q", ""),
    (906, "http://example.com/en/a", ""),
    (907, "http://a.example.com/en/", ""),
    (908, "http://example.com/en", ""),
    (909, "http://com", ""),
    (910, "http://com/", ""),
    (911, "http://telecom/", ""),
    (912, "http://a.b.net/fr/x#://y", ""),
    (913, "x\ny://h.net/es/", ""),
    (914, "http://a.net://b.com/", ""),
    (None, "http://plain1.example.org/z", None),
    (915, "http://plain1.example.org/z", "x" * 300_000 + page("//bad0.example.net/es/")),
    (915, "http://plain1.example.org/z", "x" * 300_000 + page("//bad0.example.net/es/")),
]


def check(df, rows, left_out=links.LEFT_OUT):
    want = brute.judged_pages(rows, links.RULES, links.DAMPING, left_out, links.MARGIN)
    got = [tuple(r) for r in links.judge_pages(df, left_out=left_out).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert Counter(map(str, got)) == Counter(map(str, want))
    return want


@pytest.mark.parametrize("seed, left_out", [(1, links.LEFT_OUT), (2, 0.4), (3, 0.4)])
def test_judged_pages_equal_a_plain_iteration(spark, seed, left_out):
    rows = web(random.Random(seed), 300) + AWKWARD
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    for clash in ("host", "verdict", "_bad", "mass"):
        df = df.withColumn(clash, F.lit(1))
    want = check(df.select("*", F.lit(1).alias("URL")), rows, left_out)
    unruled = {(h, v) for _, h, _, rule, v in want if rule is None and h.startswith(("farm", "plain"))}
    assert {v for h, v in unruled if h.startswith("farm")} == {"block"}
    assert "allow" in {v for h, v in unruled if h.startswith("plain")}


def test_hosts_with_many_links_are_dealt_over_parts(spark, monkeypatch):
    rows = web(random.Random(4), 200)
    whole = links.judge_pages(spark.createDataFrame(rows, PAGES), left_out=0.4).collect()
    monkeypatch.setattr(links, "LINKS_PER_PART", 2)
    monkeypatch.setattr(links, "BROADCAST_BYTES", -1)
    assert Counter(whole) == Counter(links.judge_pages(spark.createDataFrame(rows, PAGES), left_out=0.4).collect())


def test_given_pages(spark, folder):
    df = spark.read.parquet(f"{folder}/pages.parquet")
    check(df, [tuple(r) for r in df.select("page_id", "url", "html").collect()])


def test_empty_table(spark):
    assert links.judge_pages(spark.createDataFrame([], PAGES)).collect() == []


def test_no_python_and_columns_pruned(spark, folder):
    plan = links.judge_pages(spark.read.parquet(f"{folder}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "html" not in plan


def test_sql_equals_a_plain_iteration(folder):
    import duckdb
    import pandas as pd

    rows = web(random.Random(6), 400) + AWKWARD
    for given in (rows, None):
        con = duckdb.connect()
        if given is None:
            con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
            given = con.execute("SELECT page_id, url, html FROM pages").fetchall()
        else:
            con.register("pages", pd.DataFrame(given, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
        got = con.execute(links.pages_sql()).fetchall()
        want = brute.judged_pages(given, links.RULES, links.DAMPING, links.LEFT_OUT, links.MARGIN)
        assert Counter(map(str, got)) == Counter(map(str, want))
