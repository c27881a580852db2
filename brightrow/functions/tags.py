"""Tags, scores and sensitivity flags of question texts, as column expressions.

One pass over the lower-cased text, :func:`word_hits`, finds the listed words at all places;
functions of ``hits`` (its result) and ``kinds`` (the distinct ones) tell what was found. Pass
materialised columns (made by ``withColumn``), so that the pass is made once.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from brightrow.functions.text import count_words

# Words that mark the kinds of question, matched anywhere in the lower-cased text.
TYPE_WORDS = {
    "aggregation": (
        "sum", "total", "avg", "average", "count", "min", "max", "median",
        "std", "variance", "percentile", "quantile", "distribution",
    ),
    "groupby": ("by", "per", "group", "bucket", "bin"),
    "filtering": (
        "where", "with", "having", "only", "top", "greater than", "less than",
        "between", "equals", "equal to", "after", "before", "last", "this", "previous",
    ),
    "join": ("join", "vs", "versus", "compare", "union", "merge", "combine", "lookup"),
    "time_series": (
        "time", "date", "daily", "weekly", "monthly", "quarterly", "yearly", "trend", "moving average", "rolling",
    ),
    "window": ("over", "partition", "window", "lag", "lead", "rank", "dense_rank"),
    "ranking": ("top", "bottom", "rank", "most", "least"),
    "text_search": ("contains", "like", "match", "regex", "search"),
}

# The first domain with a matching word wins.
DOMAIN_WORDS = {
    "billing": ("invoice", "billing", "ar", "ap", "ledger"),
    "finance": ("revenue", "profit", "margin", "p&l", "mrr", "arr", "forecast"),
    "customer_success": ("customer", "cohort", "churn", "retention"),
    "supply_chain": ("inventory", "warehouse", "shipment", "supply"),
    "sales": ("order", "sale", "quote", "lead", "crm"),
    "platform": ("latency", "error rate", "throughput", "p99"),
}

# Words that mark sensitive questions.
FINANCIAL_WORDS = (
    "revenue", "profit", "margin", "arpu", "mrr", "arr", "invoice", "balance sheet",
    "p&l", "ledger", "capex", "opex", "payable", "receivable",
)
COMPLIANCE_WORDS = ("gdpr", "hipaa", "sox", "pci", "iso", "soc2", "audit", "compliance")

# Nouns that raise the complexity score, as whole words.
ENTITY_WORDS = (
    "product", "sku", "region", "country", "channel", "customer",
    "order", "invoice", "store", "city", "month", "quarter", "year",
)

# Patterns of personal data.
PII_PATTERNS = {
    "SSN": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "CREDIT_CARD": r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    "PAN": r"\b[A-Z]{5}\d{4}[A-Z]\b",
    "AADHAAR": r"\b\d{12}\b",
    "PHONE10": r"\b\d{10}\b",
    # A character class in place of a repeated alternation, which overflows Java's stack.
    "EMAIL": r"\b[\w.\-]+@[\w\-]+\.\w+\b",
}

# Tokens are words, possibly with an apostrophe, or numbers.
TOKEN = r"[A-Za-z_]+(?:'[A-Za-z]+)?|\d+(?:\.\d+)?"

# The complexity score. Its base; the text length that counts full, and its weight;
# weight and most occurrences of words of a type; weight of time words; weight and most of nouns.
BASE, FULL_LENGTH, LENGTH_WEIGHT = 0.12, 220.0, 0.35
COUNTED_TYPES = {"join": (0.18, 3), "groupby": (0.12, 2), "window": (0.12, 2)}
TIME_WEIGHT, NOUN_WEIGHT, MOST_NOUNS = 0.06, 0.05, 6
# The labels below these scores.
LOW_BELOW, MEDIUM_BELOW = 0.35, 0.7

# Clause names and the phrases that mark them.
CLAUSES = {
    "where": r"(?i)\bwhere\b",
    "group_by": r"(?i)\bgroup\s+by\b",
    "order_by": r"(?i)\border\s+by\b",
    "limit": r"(?i)\blimit\b",
    "join": r"(?i)\bjoin\b",
}


ALL_WORDS = tuple(
    dict.fromkeys(
        [
            *[w for words in (*TYPE_WORDS.values(), *DOMAIN_WORDS.values()) for w in words],
            *FINANCIAL_WORDS,
            *COMPLIANCE_WORDS,
            *ENTITY_WORDS,
        ]
    )
)


def _branches(words: Iterable[str]) -> str:
    """The words as one expression that tries each letter once and takes the longest word."""
    by_letter: dict[str, list[str]] = {}
    for word in words:
        by_letter.setdefault(word[0], []).append(word[1:])
    parts = []
    for letter, rests in by_letter.items():
        longer = [r for r in rests if r]
        tail = _branches(longer) + ("?" if len(longer) < len(rests) else "") if longer else ""
        parts.append(letter + tail)
    return f"(?:{'|'.join(parts)})"


def word_hits(low: Column, words: Sequence[str] = ALL_WORDS) -> Column:
    """The words of the text at all places, overlaps included; of several that begin at a place the longest."""
    return F.regexp_extract_all(low, F.lit(f"(?=({_branches(words)}))"), F.lit(1))


def _begun(words: Sequence[str], known: Sequence[str]) -> dict[str, int]:
    """Known words that begin with some of ``words``, and with how many."""
    counts = {k: sum(k.startswith(w) for w in words) for k in dict.fromkeys([*known, *words])}
    return {k: n for k, n in counts.items() if n}


def has_any(kinds: Column, words: Sequence[str], known: Sequence[str] = ALL_WORDS) -> Column:
    """Whether a text holds one of the words, given what :func:`word_hits` found of the ``known`` ones."""
    return F.arrays_overlap(kinds, F.array(*[F.lit(k) for k in _begun(words, known)]))


def count_hits(low: Column, hits: Column, words: Sequence[str], known: Sequence[str] = ALL_WORDS) -> Column:
    """Occurrences of the words, of each without overlaps."""
    # A word that can overlap itself has more places than occurrences: it is counted on its own, if it is there.
    apart = [w for w in words if any(w.startswith(w[k:]) for k in range(1, len(w)))]
    by_number: dict[int, list[str]] = {}
    for word, n in _begun([w for w in words if w not in apart], known).items():
        by_number.setdefault(n, []).append(word)
    total = F.lit(0)
    for word in apart:
        there = F.exists(hits, lambda hit: hit.startswith(word))
        total = total + F.when(there, count_words(low, [word])).otherwise(0)
    for n, found in by_number.items():
        total = total + F.size(F.filter(hits, _one_of(found))) * n
    return total


def _one_of(words: Sequence[str]):
    return lambda hit: hit.isin(*words)


def type_flags(kinds: Column) -> dict[str, Column]:
    return {tag: has_any(kinds, words) for tag, words in TYPE_WORDS.items()}


def tag_types(flags: Mapping[str, Column]) -> Column:
    """Kinds of question in a fixed order; ``filtering`` when nothing matches."""
    found = F.array_compact(F.array(*[F.when(flag, F.lit(tag)) for tag, flag in flags.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit("filtering"))).otherwise(found)


def complexity(low: Column, hits: Column, kinds: Column) -> Column:
    """Score in [0, 1] from length, joins, groupings, windows, time words and nouns."""
    nouns = F.regexp_extract_all(low, F.lit(rf"(?U)\b({'|'.join(ENTITY_WORDS)})\b"), F.lit(1))
    # Whole words are looked for only where their letters stand at all.
    whole = F.when(has_any(kinds, ENTITY_WORDS), F.size(F.array_distinct(nouns))).otherwise(0)
    score = F.lit(BASE) + F.lit(LENGTH_WEIGHT) * F.least(F.lit(1.0), F.length(low) / F.lit(FULL_LENGTH))
    for tag, (weight, most) in COUNTED_TYPES.items():
        score = score + F.lit(weight) * F.least(count_hits(low, hits, TYPE_WORDS[tag]), F.lit(most))
    score = (
        score
        + F.lit(TIME_WEIGHT) * has_any(kinds, TYPE_WORDS["time_series"]).cast("int")
        + F.lit(NOUN_WEIGHT) * F.least(whole, F.lit(MOST_NOUNS))
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def complexity_label(score: Column) -> Column:
    return F.when(score < LOW_BELOW, "low").when(score < MEDIUM_BELOW, "medium").otherwise("high")


def domain(kinds: Column) -> Column:
    out = None
    for name, words in DOMAIN_WORDS.items():
        out = (F if out is None else out).when(has_any(kinds, words), F.lit(name))
    return out


def pii_hits(c: Column, most: int | None = None) -> Column:
    """Array of (match, label) in the original text, all or the first ``most``; a match may carry several labels."""
    found = {}
    for label, pattern in PII_PATTERNS.items():
        found[label] = _labelled(F.regexp_extract_all(c, F.lit("(?U)" + pattern), F.lit(0)), label)
    email = found.pop("EMAIL")
    none = F.array().cast("array<struct<match: string, label: string>>")
    # Cheap looks first: an address has its sign, anything else three digits in a row.
    hits = F.concat(
        F.when(c.rlike(r"(?U)\d\d\d"), F.flatten(F.array(*found.values()))).otherwise(none),
        F.when(c.contains("@"), email).otherwise(none),
    )
    return F.when(c.isNotNull(), hits if most is None else F.slice(hits, 1, most))


def _labelled(matches: Column, label: str) -> Column:
    return F.transform(matches, lambda m: F.struct(m.alias("match"), F.lit(label).alias("label")))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(32), F.ceil(F.length(c) / 4).cast("int"))


def distinct_words(low: Column) -> Column:
    """Distinct purely alphabetic tokens."""
    tokens = F.array_distinct(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)))
    return F.size(F.filter(tokens, lambda t: t.rlike("^[a-z]+$")))


def join_words(low: Column, hits: Column, known: Sequence[str] = ALL_WORDS) -> Column:
    return count_hits(low, hits, TYPE_WORDS["join"], known)


def clauses(c: Column) -> Column:
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(name)) for name, p in CLAUSES.items()]))
