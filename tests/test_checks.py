"""Validation, nested data, HTML and triage on small samples."""

import random
import pytest
from pyspark.sql import functions as F

from brightrow.functions import tags
from brightrow.operators import html, nested, triage, validate


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Ann", 5.0), (0, "B0b", None), (None, None, 99.0), (4, "Eve", float("nan"))]
    return spark.createDataFrame(rows, "id int, name string, score double")


def report(df):
    return {r["column"]: r for r in df.collect()}


def test_rules_in_one_pass(people):
    rules = {
        "id": {"min": 1, "pattern": "never read"},
        "name": {"pattern": "[A-Za-z ]+$"},
        "score": {"allowed": [5.0, None]},
        "absent": {"min": 1},
        "unchecked": {"type": "string"},
    }
    got = report(validate.validate(people, rules))
    assert {c: (r["rule"], r["invalid_count"], r["status"]) for c, r in got.items()} == {
        "id": ("range", 1, "fail"),
        "name": ("pattern", 2, "fail"),
        "score": ("allowed", 2, "fail"),
        "absent": ("range", 0, "pass"),
    }
    with pytest.raises(ValueError):
        validate.validate(people, rules, raise_on_error=True)
    assert validate.check_regex(people, "name", "[A-Za-z]", allow_null=True).first()["invalid_count"] == 0
    assert validate.validate(people, {}).count() == 0


def test_pattern_matches_at_the_start_only(spark):
    df = spark.createDataFrame([("abc1",), ("1abc",)], "s string")
    assert validate.check_regex(df, "s", "(?P<x>[a-z]+)").first()["invalid_count"] == 1


def test_nan_is_missing(people):
    assert {c: r["missing_count"] for c, r in report(validate.check_missing(people)).items()} == {
        "id": 1,
        "name": 1,
        "score": 2,
    }


def test_null_keys_differ_between_the_two_checks(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (1,)], "p int")
    assert validate.check_fk(child, "k", parent, "p").first()["invalid_count"] == 2
    assert validate.fk_violations(child, {"k": (parent, "p")}).first()["violations"] == 1
    assert validate.fk_rows(child, "k", parent, "p").count() == 2


def test_schema_checks_raise(people):
    with pytest.raises(ValueError):
        validate.check_schema(people, ["id", "x"], raise_on_error=True)
    with pytest.raises(TypeError):
        validate.check_types(people, {"id": "string"}, raise_on_error=True)
    assert validate.check_types(people, {"id": "integer", "score": "double"}).where("not matches").count() == 0


def test_flatten_and_paths(spark):
    kind = "id int, a struct<b: int, c: struct<d: string>>, l array<struct<x: int>>, e array<string>"
    df = spark.createDataFrame([(1, (2, ("z",)), [(7,), (8,)], None)], kind)
    assert nested.flatten(df, "_").columns == ["id", "a_b", "a_c_d", "l", "e"]
    got = {r["path"]: r["value"] for r in nested.flatten_indexed(df, ["id"]).collect()}
    assert got == {"a.b": "2", "a.c.d": "z", "l[0].x": "7", "l[1].x": "8"}
    with pytest.raises(ValueError):
        nested.widen(df, ["id"], max_paths=2)


def test_messages_that_are_no_objects_stay_raw(spark):
    values = ['{"a": 1}', "[1]", '"x"', "nope", None, '{"b": 2}']
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = {r["i"]: (r["a"], r["raw"]) for r in nested.parse_messages(df, "v", "a int", ["i"]).collect()}
    assert got == {0: (1, None), 1: (None, "[1]"), 2: (None, '"x"'), 3: (None, "nope"), 4: (None, None), 5: (None, None)}


def test_json_schema_is_found(spark):
    df = spark.createDataFrame([('{"a": {"b": 1}}',), ('{"a": {"c": [1, 2]}}',)], "v string")
    out = nested.flatten(nested.parse_json(df, "v"), ".", arrays="json")
    assert sorted(out.columns) == ["v.a.b", "v.a.c"]
    assert {tuple(r) for r in out.select("`v.a.b`", "`v.a.c`").collect()} == {(1, None), (None, "[1,2]")}


PAGE = """<html><head><title>T &amp; x</title><style>p{}</style></head><body id=main>
<p class="a b">one <b>two</b><br>three</p><script>var p="</p>";</script><template><i>no</i></template>
<div><p>four</p></div><!-- gone --><table><tr><th>Name</th><th>Age</th></tr>
<tr><td> Alice </td><td>30</td></tr><tr><td>Bob<td>&lt;41</table></body></html>"""


def test_page_text():
    text = " ".join(html.page_text(PAGE).split())
    assert text == "T & x one twothree fourNameAge Alice 30Bob<41"
    assert html.page_text(None) is None


def test_html_selectors(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None)], "k int, h string")
    out = html.html_select(df, "h", "k", ["p", "p.a", "div p", "#main b", "title"])
    got = {(r["selector"], r["position"]): r["text"] for r in out.collect()}
    assert got == {
        ("p", 0): "one twothree",
        ("p", 1): "four",
        ("p.a", 0): "one twothree",
        ("div p", 0): "four",
        ("#main b", 0): "two",
        ("title", 0): "T & x",
    }
    with pytest.raises(ValueError):
        html.html_select(df, "h", "k", ["p > a"])


def test_html_table_columns(spark):
    df = spark.createDataFrame([(1, PAGE)], "k int, h string")
    out = html.table_columns(html.html_tables(df, "h", "k"), ["Name", "Age"], "k").orderBy("row_index")
    assert [(r["Name"], r["Age"]) for r in out.collect()] == [("Alice", "30"), ("Bob", "<41")]


QUESTIONS = (
    "complexity double, domain string, token_estimate int, text string, force_strategy string, cost_hard_limit double"
)


@pytest.mark.parametrize(
    "row, strategy, reason",
    [
        ((0.2, "sales", None, "total sales last week", None, None), "rule_based", "below_complexity_threshold"),
        ((0.9, "sales", None, "compare revenue growth by region", None, None), "llm_based", "above_complexity_threshold"),
        ((0.9, "sales", 20000, "complex query", None, 1e-6), "rule_based", "cost_guard_triggered"),
        ((0.6, "finance", None, "revenue recognition by quarter", None, None), "rule_based", "domain_policy_preference"),
        ((0.1, "sales", None, "simple", "llm_based", None), "llm_based", "forced_by_context_option"),
        ((90.0, None, 40000, "long", None, None), "rule_based", "latency_slo_guard"),
    ],
)
def test_routing(spark, row, strategy, reason):
    out = triage.route(spark.createDataFrame([row], QUESTIONS)).first()
    assert (out["strategy"], out["reason"]) == (strategy, reason)


def test_routing_switches(spark):
    df = spark.createDataFrame([(0.9, "sales", None, "x", None, None)], QUESTIONS)
    assert triage.route(df, triage.TriageRules(allow_model=False)).first()["reason"] == "llm_disabled_globally"
    only = triage.TriageRules(allowed_model_domains=frozenset({"platform"}))
    assert triage.route(df, only).first()["reason"] == "domain_policy_preference"
    assert triage.route(df.withColumn("pii", F.lit(True))).first()["reason"] == "safety_policy_preference"


def test_classification_record(spark):
    text = "Compare total revenue by region for gdpr audit, mail a.b-c@d-e.org or 1234 5678 9012 3456"
    df = spark.createDataFrame([(text,), ("  ",)], "q string")
    full, empty = triage.classify_table(df, "q").collect()
    assert full["types"] == ["aggregation", "groupby", "join"]
    assert full["domain"] == "billing"  # "ar" occurs inside "compare"
    assert full["pii"] and full["financial_sensitive"] and full["compliance_sensitive"]
    assert [h["label"] for h in full["hits"]] == ["CREDIT_CARD", "EMAIL"]
    assert full["hits"][1]["match"] == "a.b-c@d-e.org"
    assert full["complexity"] == pytest.approx(0.12 + 0.35 * len(text) / 220 + 0.18 * 1 + 0.12 * 1 + 0.05 * 1)
    assert (empty["types"], empty["complexity"], empty["complexity_label"], empty["domain"]) == ([], 0.0, "low", None)
    assert (empty["entities_count"], empty["estimated_joins"], empty["token_estimate"]) == (0, 0, 32)


def test_long_tokens_do_not_overflow_the_mail_pattern(spark):
    df = spark.createDataFrame([("x" * 20000 + " me@here.org",)], "t string")
    hits = df.select(tags.pii_hits(F.col("t")).alias("h")).first()["h"]
    assert [h["match"] for h in hits] == ["me@here.org"]


def test_words_found_in_one_pass_equal_one_search_per_word(spark):
    """All places, words within words and across one another; a missing text gives nulls."""
    rng = random.Random(11)
    bits = [w[:k] for w in tags.ALL_WORDS for k in (1, 2, 3, len(w))] + [" ", "é", "&", "_"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 40))) for _ in range(300)] + ["windowindow windowindowindow", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, low string")
    found = triage.with_hits(df, "low")
    groups = {**tags.TYPE_WORDS, **tags.DOMAIN_WORDS, "fin": tags.FINANCIAL_WORDS, "entity": tags.ENTITY_WORDS}
    rows = found.select(
        "low",
        *[tags.has_any(F.col("__kinds"), words).alias(name) for name, words in groups.items()],
        *[tags.count_hits(F.col("low"), F.col("__hits"), tags.TYPE_WORDS[name]).alias(f"n_{name}") for name in tags.COUNTED_TYPES],
    ).collect()
    for row in rows:
        if row["low"] is None:
            assert all(row[name] is None for name in groups)
            continue
        for name, words in groups.items():
            assert row[name] == any(w in row["low"] for w in words), (name, row["low"])
        for name in tags.COUNTED_TYPES:
            assert row[f"n_{name}"] == sum(row["low"].count(w) for w in tags.TYPE_WORDS[name]), (name, row["low"])
