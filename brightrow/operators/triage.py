"""Triage of a question log: which questions take the rule-based way."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from brightrow.columns import ref
from brightrow.functions import tags
from brightrow.functions.text import contains_any, strip

# The strategies, the reasons and the price and latency model.
RULE, MODEL = "rule_based", "llm_based"
PRICE_PER_TOKEN = 1.5e-7
RULE_MS, MODEL_MS = (80, 100, 50), (600, 20, 2500)
LOW_TIER, MEDIUM_TIER = 0.001, 0.01
# Word to domain of the light scorer, the first match wins.
LIGHT_DOMAINS = {
    "revenue": "finance",
    "invoice": "billing",
    "tax": "compliance",
    "churn": "customer_success",
    "customer": "sales",
    "order": "sales",
    "inventory": "supply_chain",
    "latency": "platform",
}
LIGHT_JOINS = (" join ", " vs ", " compare ", " correlation ", " by ")
LIGHT_ENTITIES = (" product", " sku", " region", " country", " channel", " city", " month", " quarter")
LIGHT_PII = ("ssn", "aadhaar", "credit card", "dob")
LIGHT_COMPLIANCE = ("tax", "gdpr")


@dataclass(frozen=True)
class TriageRules:
    complexity_threshold: float = 0.45
    allowed_model_domains: frozenset[str] | None = None
    rule_domains: frozenset[str] = field(default_factory=lambda: frozenset({"finance", "billing", "compliance"}))
    cost_hard_limit: float = 0.10
    daily_budget_remaining: float = 50.0
    latency_slo_ms: int = 2000
    allow_model: bool = True


def _latency(tokens: Column, model: tuple[int, int, int]) -> Column:
    base, per, most = model
    return F.lit(base) + F.least(F.floor(tokens / per).cast("int"), F.lit(most))


def _tier(cost: Column) -> Column:
    return F.when(cost <= LOW_TIER, "low").when(cost <= MEDIUM_TIER, "medium").otherwise("high")


def route(df: DataFrame, rules: TriageRules = TriageRules(), text_col: str | None = "text") -> DataFrame:
    """Add strategy, reason, cost tier and estimates to every question.

    Reads the columns complexity, domain, pii, compliance_sensitive, token_estimate,
    estimated_joins, entities_count and, for overrides per question,
    force_strategy, cost_hard_limit, daily_budget_remaining, latency_slo_ms and
    allow_model; absent columns take the defaults.
    """

    def given(name: str, default, kind: str) -> Column:
        fallback = F.lit(default).cast(kind)
        return F.coalesce(ref(name).cast(kind), fallback) if name in df.columns else fallback

    length = F.length(ref(text_col)) if text_col in df.columns else F.lit(0)
    tokens = F.coalesce(given("token_estimate", None, "int"), F.greatest(F.lit(32), F.floor(length / 4).cast("int")))
    joins, entities = given("estimated_joins", 0, "int"), given("entities_count", 0, "int")
    stated = given("complexity", None, "double")
    scaled = F.when(stated.between(0, 1), stated).otherwise(F.least(F.lit(1.0), stated / 100))
    score = F.coalesce(scaled, F.least(F.lit(1.0), F.lit(0.2) + 0.15 * joins + 0.05 * entities))
    topic = given("domain", None, "string")
    cost = F.lit(PRICE_PER_TOKEN) * tokens
    slow, quick = _latency(tokens, MODEL_MS), _latency(tokens, RULE_MS)
    slo = given("latency_slo_ms", rules.latency_slo_ms, "int")
    hard = given("cost_hard_limit", rules.cost_hard_limit, "double")
    daily = given("daily_budget_remaining", rules.daily_budget_remaining, "double")
    sensitive = given("pii", False, "boolean") | given("compliance_sensitive", False, "boolean")
    forced = given("force_strategy", None, "string")
    is_forced = F.coalesce(forced.isin(RULE, MODEL), F.lit(False))
    by_domain = F.coalesce(topic.isin(sorted(rules.rule_domains)), F.lit(False))
    if rules.allowed_model_domains is not None:
        by_domain = by_domain | ~F.coalesce(topic.isin(sorted(rules.allowed_model_domains)), F.lit(False))

    # Fixed order of the tests: the strictest comes first.
    reason = (
        F.when(is_forced, "forced_by_context_option")
        .when(~given("allow_model", rules.allow_model, "boolean"), "llm_disabled_globally")
        .when(sensitive, "safety_policy_preference")
        .when(by_domain, "domain_policy_preference")
        .when((slow > slo) & (quick <= slo), "latency_slo_guard")
        .when((cost > hard) | (daily < cost), "cost_guard_triggered")
        .when(score <= rules.complexity_threshold, "below_complexity_threshold")
        .otherwise("above_complexity_threshold")
    )
    strategy = (
        F.when(is_forced, forced)
        .when(F.col("reason") == "above_complexity_threshold", MODEL)
        .otherwise(RULE)
    )
    charged = F.when((F.col("strategy") == MODEL) | is_forced, cost).otherwise(F.lit(0.0))
    return (
        df.withColumn("reason", reason)
        .withColumn("strategy", strategy)
        .withColumn("cost_tier", _tier(charged))
        .withColumns({"tokens": tokens, "cost_usd": cost, "latency_ms_rule": quick, "latency_ms_model": slow})
    )


# The columns of a classification record, with the values of an empty text.
RECORD = (
    "types", "complexity", "complexity_label", "pii", "financial_sensitive", "compliance_sensitive",
    "hits", "domain", "entities_count", "estimated_joins", "token_estimate",
)


def lowered(df: DataFrame, col: str, into: str = "__low") -> DataFrame:
    """The text lower-cased once, for the word tests that follow."""
    return df.withColumn(into, F.lower(ref(col)))


def with_hits(df: DataFrame, low: str, words=tags.ALL_WORDS) -> DataFrame:
    """Add ``__hits``, the listed words of the lower-cased text, and ``__kinds``, the distinct ones."""
    return df.withColumn("__hits", tags.word_hits(ref(low), words)).withColumn("__kinds", F.array_distinct("__hits"))


def tag_types(df: DataFrame, kinds: str = "__kinds", into: str = "types") -> DataFrame:
    """Add the kinds of question; the word tests run first, as plain boolean columns."""
    flags = {f"__is_{tag}": flag for tag, flag in tags.type_flags(ref(kinds)).items()}
    tagged = df.withColumns(flags).withColumn(
        into, tags.tag_types({tag: F.col(f"__is_{tag}") for tag in tags.TYPE_WORDS})
    )
    return tagged.drop(*flags)


def classify_table(df: DataFrame, col: str) -> DataFrame:
    """Add the classification record of a text column as columns.

    An empty (or blank) text has no types, no domain, zero scores and 32 tokens.
    """
    staged = with_hits(lowered(df.withColumn("__text", strip(ref(col))), "__text"), "__low")
    low, text, hits, kinds = F.col("__low"), F.col("__text"), F.col("__hits"), F.col("__kinds")
    scored = tag_types(staged).withColumns(
        {
            "complexity": tags.complexity(low, hits, kinds),
            "hits": tags.pii_hits(text),
            "financial_sensitive": tags.has_any(kinds, tags.FINANCIAL_WORDS),
            "compliance_sensitive": tags.has_any(kinds, tags.COMPLIANCE_WORDS),
            "domain": tags.domain(kinds),
            "entities_count": tags.distinct_words(low),
            "estimated_joins": tags.join_words(low, hits),
            "token_estimate": tags.token_estimate(text),
        }
    )
    empty = F.col("__text") == ""
    record = scored.withColumns(
        {
            "types": F.when(empty, F.array().cast("array<string>")).otherwise(F.col("types")),
            "complexity": F.when(empty, F.lit(0.0)).otherwise(F.col("complexity")),
            "pii": F.size("hits") > 0,
        }
    ).withColumn("complexity_label", tags.complexity_label(F.col("complexity")))
    return record.select(*[ref(c) for c in df.columns], *RECORD)


def light_scores(df: DataFrame, col: str) -> DataFrame:
    """Domain, complexity and safety by the light scorer."""
    low = F.col("__low")
    topic = None
    for word, name in LIGHT_DOMAINS.items():
        topic = (F if topic is None else topic).when(F.contains(low, F.lit(word)), F.lit(name))
    joins = sum((F.contains(low, F.lit(w)).cast("int") for w in LIGHT_JOINS), F.lit(0))
    entities = sum((F.contains(low, F.lit(w)).cast("int") for w in LIGHT_ENTITIES), F.lit(0))
    length = F.least(F.lit(1.0), F.length(ref(col)) / F.lit(200.0))
    score = F.lit(0.15) + F.lit(0.2) * F.col("estimated_joins") + F.lit(0.05) * F.col("entities_count")
    return (
        lowered(df, col)
        .withColumns({"domain": topic, "estimated_joins": joins, "entities_count": entities})
        .withColumn("complexity", F.least(F.lit(1.0), score + F.lit(0.4) * length))
        .withColumns(
            {
                "pii": contains_any(low, LIGHT_PII),
                "compliance_sensitive": contains_any(low, LIGHT_COMPLIANCE),
                "token_estimate": F.greatest(F.lit(32), F.floor(F.length(ref(col)) / 4).cast("int")),
            }
        )
        .drop("__low")
    )


def route_simple(df: DataFrame, col: str = "text", rules: TriageRules = TriageRules()) -> DataFrame:
    return route(light_scores(df, col), rules, col)


def quick_route(c: Column) -> Column:
    """``rule`` for questions that mention sum or count, else ``llm``."""
    return F.when(contains_any(F.lower(c), ("sum", "count")), "rule").otherwise("llm")
