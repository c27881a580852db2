"""Tags, scores, personal data and triage of texts."""

from pyspark.sql import functions as F

from brightrow.functions import tags
from brightrow.operators import triage
from brightrow.suite.registry import SQL_STRIP, query, rounded, table


def _any(words, text="low") -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


def _count(words, text="low") -> str:
    return "(" + " + ".join(
        f"CAST((length({text}) - length(replace({text}, '{w}', ''))) / {len(w)} AS INT)" for w in words
    ) + ")"


_Q = "(SELECT conv_id, turn, text, lower(text) AS low FROM conversations)"
_TYPES = (
    "list_filter([" + ", ".join(f"CASE WHEN {_any(w)} THEN '{t}' END" for t, w in tags.TYPE_WORDS.items())
    + "], lambda t: t IS NOT NULL)"
)
_TYPE_TEXT = f"coalesce(nullif(array_to_string({_TYPES}, ','), ''), 'filtering')"
_DOMAIN = "CASE " + " ".join(f"WHEN {_any(w)} THEN '{t}'" for t, w in tags.DOMAIN_WORDS.items()) + " END"
_ENTITIES = (
    "len(list_distinct(list_filter(regexp_extract_all(low, '[\\p{L}\\p{N}_]+'), lambda w: w IN ("
    + ", ".join(f"'{w}'" for w in tags.ENTITY_WORDS)
    + "))))"
)
_SCORE = (
    "least(1.0::DOUBLE, 0.12::DOUBLE + 0.35::DOUBLE * least(1.0::DOUBLE, length(text) / 220.0::DOUBLE)"
    f" + 0.18::DOUBLE * least({_count(tags.TYPE_WORDS['join'])}, 3)"
    f" + 0.12::DOUBLE * least({_count(tags.TYPE_WORDS['groupby'])}, 2)"
    f" + 0.12::DOUBLE * least({_count(tags.TYPE_WORDS['window'])}, 2)"
    f" + 0.06::DOUBLE * CAST({_any(tags.TYPE_WORDS['time_series'])} AS INT)"
    f" + 0.05::DOUBLE * least({_ENTITIES}, 6))"
)
_WORDS = (
    "len(list_distinct(list_filter(regexp_extract_all(low, '[A-Za-z_]+(?:''[A-Za-z]+)?|\\d+(?:\\.\\d+)?'),"
    " lambda w: regexp_full_match(w, '[a-z]+'))))"
)
_TOKENS = "greatest(32, CAST(ceil(length(text) / 4.0) AS INT))"


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "text")


def _low_turns(spark, d):
    return triage.lowered(_turns(spark, d), "text", "low").select("conv_id", "turn", "low")


@query("question_types", f"SELECT conv_id, turn, {_TYPE_TEXT} AS types FROM {_Q}")
def _(spark, d):
    rows = triage.tag_types(triage.with_hits(_low_turns(spark, d), "low"))
    return rows.select("conv_id", "turn", F.array_join("types", ",").alias("types"))


@query(
    "question_complexity",
    f"SELECT conv_id, turn, round(s, 6) AS complexity, CASE WHEN s < 0.35 THEN 'low' WHEN s < 0.7 THEN 'medium'"
    f" ELSE 'high' END AS label FROM (SELECT conv_id, turn, {_SCORE} AS s FROM {_Q})",
)
def _(spark, d):
    rows = triage.with_hits(_low_turns(spark, d), "low")
    score = tags.complexity(F.col("low"), F.col("__hits"), F.col("__kinds"))
    rows = rows.withColumn("complexity", score).drop("low", "__hits", "__kinds")
    return rounded(rows.withColumn("label", tags.complexity_label(F.col("complexity"))), "complexity")


@query("question_domain", f"SELECT conv_id, turn, {_DOMAIN} AS domain FROM {_Q}")
def _(spark, d):
    rows = triage.with_hits(_low_turns(spark, d), "low")
    return rows.select("conv_id", "turn", tags.domain(F.col("__kinds")).alias("domain"))


_PII = " , ".join(
    "len(regexp_extract_all(text, '{}')) AS {}".format(p, label.lower()) for label, p in tags.PII_PATTERNS.items()
)


@query(
    "personal_data",
    f"""
    SELECT doc_id, ssn, credit_card, pan, aadhaar, phone10, email,
           ssn + credit_card + pan + aadhaar + phone10 + email > 0 AS pii, financial, compliance
    FROM (SELECT doc_id, {_PII}, {_any(tags.FINANCIAL_WORDS, 'lower(text)')} AS financial,
                 {_any(tags.COMPLIANCE_WORDS, 'lower(text)')} AS compliance FROM documents)
    """,
)
def _(spark, d):
    sensitive, kinds = (*tags.FINANCIAL_WORDS, *tags.COMPLIANCE_WORDS), F.col("__kinds")
    rows = triage.with_hits(triage.lowered(table(spark, d, "documents"), "text", "low"), "low", sensitive).select(
        "doc_id",
        tags.pii_hits(F.col("text")).alias("hits"),
        tags.has_any(kinds, tags.FINANCIAL_WORDS, sensitive).alias("financial"),
        tags.has_any(kinds, tags.COMPLIANCE_WORDS, sensitive).alias("compliance"),
    )
    counts = {
        label.lower(): F.size(F.filter("hits", _labelled(label))).cast("long") for label in tags.PII_PATTERNS
    }
    return rows.withColumns(counts).withColumn("pii", F.size("hits") > 0).drop("hits")


def _labelled(label):
    return lambda h: h["label"] == label


@query(
    "token_counts",
    f"SELECT conv_id, turn, {_TOKENS} AS tokens, CAST({_WORDS} AS INT) AS words,"
    f" {_count(tags.TYPE_WORDS['join'])} AS joins FROM {_Q}",
)
def _(spark, d):
    low, joins = F.col("low"), tags.TYPE_WORDS["join"]
    return triage.with_hits(_low_turns(spark, d), "low", joins).select(
        "conv_id",
        "turn",
        tags.token_estimate(low).alias("tokens"),
        tags.distinct_words(low).alias("words"),
        tags.join_words(low, F.col("__hits"), joins).alias("joins"),
    )


def _hit_list() -> str:
    parts = [
        f"list_transform(regexp_extract_all(text, '{p}'), lambda m: concat('{label}=', m))"
        for label, p in tags.PII_PATTERNS.items()
    ]
    return "flatten([" + ", ".join(parts) + "])"


_RECORD = f"""
  SELECT doc_id, {_TYPE_TEXT} AS types, round({_SCORE}, 6) AS complexity, {_DOMAIN} AS domain,
         CAST({_WORDS} AS INT) AS entities_count, {_count(tags.TYPE_WORDS['join'])} AS estimated_joins,
         {_TOKENS} AS token_estimate, md5(array_to_string({_hit_list()}, ';')) AS hits
  FROM (SELECT doc_id, text, lower(text) AS low FROM
        (SELECT doc_id, regexp_replace(text, {SQL_STRIP}, '', 'g') AS text FROM documents))
"""


@query("classify_documents", _RECORD)
def _(spark, d):
    rows = triage.classify_table(table(spark, d, "documents").select("doc_id", "text"), "text")
    hits = F.transform("hits", lambda h: F.concat(h["label"], F.lit("="), h["match"]))
    out = rows.select(
        "doc_id",
        F.array_join("types", ",").alias("types"),
        "complexity",
        "domain",
        "entities_count",
        "estimated_joins",
        "token_estimate",
        F.md5(F.array_join(hits, ";")).alias("hits"),
    )
    return rounded(out, "complexity")


_ROUTED = """
  SELECT doc_id, reason, CASE WHEN reason = 'above_complexity_threshold' THEN 'llm_based' ELSE 'rule_based' END AS strategy,
         CASE WHEN reason <> 'above_complexity_threshold' OR cost <= 0.001 THEN 'low' WHEN cost <= 0.01 THEN 'medium'
              ELSE 'high' END AS cost_tier,
         tokens, 80 + least(tokens // 100, 50) AS latency_ms_rule, 600 + least(tokens // 20, 2500) AS latency_ms_model
  FROM (SELECT *, tokens * 1.5e-7::DOUBLE AS cost, CASE
          WHEN sensitive THEN 'safety_policy_preference'
          WHEN coalesce(domain IN ('finance', 'billing', 'compliance'), false) THEN 'domain_policy_preference'
          WHEN 600 + least(tokens // 20, 2500) > 2000 AND 80 + least(tokens // 100, 50) <= 2000 THEN 'latency_slo_guard'
          WHEN tokens * 1.5e-7::DOUBLE > 0.0004 THEN 'cost_guard_triggered'
          WHEN s <= 0.45 THEN 'below_complexity_threshold' ELSE 'above_complexity_threshold' END AS reason
        FROM ({source}))
"""
_ROUTE_SOURCE = f"""
  SELECT doc_id, {_SCORE} AS s, {_DOMAIN} AS domain, {_TOKENS} AS tokens,
         ({' OR '.join(f"regexp_matches(text, '{p}')" for p in tags.PII_PATTERNS.values())}
          OR {_any(tags.COMPLIANCE_WORDS)}) AS sensitive
  FROM (SELECT doc_id, text, lower(text) AS low FROM
        (SELECT doc_id, regexp_replace(text, {SQL_STRIP}, '', 'g') AS text FROM documents))
"""
_ROUTE_COLUMNS = ["doc_id", "reason", "strategy", "cost_tier", "tokens", "latency_ms_rule", "latency_ms_model"]


@query("route_documents", _ROUTED.format(source=_ROUTE_SOURCE))
def _(spark, d):
    rows = triage.classify_table(table(spark, d, "documents").select("doc_id", "text"), "text")
    return triage.route(rows, triage.TriageRules(cost_hard_limit=0.0004)).select(*_ROUTE_COLUMNS)


_LIGHT_SOURCE = f"""
  SELECT doc_id, tokens, domain, sensitive, least(1.0::DOUBLE, 0.15::DOUBLE + 0.2::DOUBLE * joins
         + 0.05::DOUBLE * entities + 0.4::DOUBLE * least(1.0::DOUBLE, length(text) / 200.0::DOUBLE)) AS s
  FROM (SELECT doc_id, text, greatest(32, length(text) // 4) AS tokens,
          CASE {' '.join(f"WHEN contains(low, '{w}') THEN '{t}'" for w, t in triage.LIGHT_DOMAINS.items())} END AS domain,
          {_any(triage.LIGHT_PII + triage.LIGHT_COMPLIANCE)} AS sensitive,
          {' + '.join(f"contains(low, '{w}')::INT" for w in triage.LIGHT_JOINS)} AS joins,
          {' + '.join(f"contains(low, '{w}')::INT" for w in triage.LIGHT_ENTITIES)} AS entities
        FROM (SELECT doc_id, text, lower(text) AS low FROM documents))
"""


@query("route_documents_lightly", _ROUTED.format(source=_LIGHT_SOURCE))
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text")
    return triage.route_simple(rows, "text", triage.TriageRules(cost_hard_limit=0.0004)).select(*_ROUTE_COLUMNS)


@query(
    "quick_route",
    f"SELECT conv_id, turn, CASE WHEN {_any(('sum', 'count'))} THEN 'rule' ELSE 'llm' END AS route FROM {_Q}",
)
def _(spark, d):
    return _turns(spark, d).select("conv_id", "turn", triage.quick_route(F.col("text")).alias("route"))


@query(
    "clause_tags",
    "SELECT conv_id, turn, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in tags.CLAUSES.items())
    + "], lambda t: t IS NOT NULL), ',') AS clauses FROM (SELECT conv_id, turn, concat(CASE WHEN turn % 3 = 0 THEN"
    " 'Order  BY name WHERE ' WHEN turn % 3 = 1 THEN 'group by city, LIMIT ' ELSE '' END, text) AS text FROM conversations)",
)
def _(spark, d):
    lead = (
        F.when(F.col("turn") % 3 == 0, "Order  BY name WHERE ")
        .when(F.col("turn") % 3 == 1, "group by city, LIMIT ")
        .otherwise("")
    )
    rows = _turns(spark, d).withColumn("text", F.concat(lead, "text"))
    return rows.select("conv_id", "turn", F.array_join(tags.clauses(F.col("text")), ",").alias("clauses"))
