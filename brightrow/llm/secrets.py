"""Secret scans with one combined automaton.

What each rule begins with (``sought``, by default its head) is compiled into one minimal
deterministic automaton for all rules, which reads every byte once (``automaton.run``).
Where it accepts, the stretch since its last visit of the root state holds every match
that may have begun, and the rule's own automaton, built the same way, gives the exact
spans from there: leftmost, longest, not overlapping per kind.

Null and empty texts have no spans. Rows that repeat give the same result each. Spans
are code points, end exclusive. A text is read whole at any length.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from brightrow.llm import automaton
from brightrow.llm.automaton import SEPARATOR, Automaton
from brightrow.llm.common import annotate, groups, joined


@dataclass(frozen=True)
class Rule:
    """``head`` then ``body`` of at least ``least`` characters; a shorter body drops the match."""

    kind: str
    head: str
    body: str
    least: int
    either: bool = False  # the head's letters in either case
    sought: str = ""  # a beginning of every match that the combined automaton looks for, if not the head


RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
        r"[A-Za-z0-9+/_.=-]+",
        12,
        either=True,
    ),
    Rule("access", "AKIA", "[A-Z0-9]+", 14),
    Rule("hex", "", "[0-9a-f]+", 16, sought="[0-9a-f]{16}"),
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", 10),
    Rule("google", "AIza", r"[0-9A-Za-z_-]+", 35),
    Rule("stripe", "[rs]k_(live|test)_", "[0-9A-Za-z]+", 16),
    Rule("model", "sk-(ant-|proj-)?", "[A-Za-z0-9_-]+", 32),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 20, sought="eyJ"),
    Rule("pem", "-----BEGIN ((RSA|EC|DSA|OPENSSH|ENCRYPTED|PGP) )?PRIVATE KEY", "( BLOCK)?-----", 5),
    Rule(
        "login",
        r"(https?|ftp|ssh|postgres(ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~%-]+:",
        r"[A-Za-z0-9._~%!$&*+=-]+@",
        5,
        sought="(https?|ftp|ssh|postgres(ql)?|mysql|mongodb|redis|amqp)://",
    ),
)
BASE = ("assign", "access", "hex")


@cache
def _machines() -> tuple[Automaton, np.ndarray, tuple[tuple[Automaton, Automaton], ...]]:
    """The combined automaton, which of its states accept, and per rule its head and whole."""
    heads, wholes, sought = [], [], []
    for rule in RULES:
        head = automaton.parse(rule.head)
        head = automaton.either_case(head) if rule.either else head
        whole = ("seq", [head, automaton.parse(rule.body)])
        heads.append(head)
        wholes.append(whole)
        sought.append(automaton.parse(rule.sought) if rule.sought else head)
    combined = automaton.compile_rules(sought)
    ends = np.repeat(np.array([bool(a) for a in combined.accepts]), combined.width)
    anchored = lambda t: automaton.compile_rules([t], anchored=True)
    own = []
    for head, whole in zip(heads, wholes):
        first, second = anchored(head), anchored(whole)
        own.append(tuple(_listed(m) for m in (first, second)))
    return combined, ends, tuple(own)


def _listed(machine: Automaton) -> Automaton:
    """As plain lists, which single steps read faster."""
    return Automaton(machine.table.tolist(), machine.classes.tolist(), machine.width, machine.accepts)


def spans_of(texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """Per text: (start, rule number, end) in bytes, sorted."""
    combined, ends, own = _machines()
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for low, high in groups(texts):
        data, starts = joined(texts[low:high], bytes([SEPARATOR]))
        states = automaton.run(combined.table, combined.classes, data)
        hits = np.flatnonzero(ends[states])
        if not len(hits):
            continue
        roots = np.flatnonzero(states == automaton.ROOT)
        before = np.searchsorted(roots, hits) - 1
        begins = np.where(before >= 0, roots[np.maximum(before, 0)] + 1, 0)
        docs = np.searchsorted(starts, hits, side="right") - 1
        reached: dict[tuple[int, int], int] = {}  # per text and rule: where its next match may begin
        for hit, begin, doc, state in zip(hits.tolist(), begins.tolist(), docs.tolist(), states[hits].tolist()):
            text, shift, rules = texts[low + doc], int(starts[doc]), combined.accepts[state // combined.width]
            for k, rule in enumerate(RULES):
                if not rules >> k & 1:
                    continue
                head, whole = own[k]
                at = max(reached.get((doc, k), 0), begin - shift)
                while at <= hit - shift:
                    stop = whole.longest(text, at)
                    if stop < 0:
                        at += 1
                        continue
                    if stop - head.longest(text, at) >= rule.least:
                        found[low + doc].append((at, k, stop))
                    at = stop
                reached[doc, k] = at
    for spans in found:
        spans.sort()
    return found


def _in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or text.isascii():
        return spans
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    return [(int(lead[a]), k, int(lead[b])) for a, k, b in spans]


def _work(texts: list[bytes | None]):
    whole = [t or b"" for t in texts]
    kinds, begins, finishes = [], [], []
    for text, spans in zip(whole, spans_of(whole)):
        points = _in_code_points(text, spans)
        kinds.append([RULES[k].kind for _, k, _ in points])
        begins.append([a for a, _, _ in points])
        finishes.append([b for _, _, b in points])
    return kinds, begins, finishes


def find_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``secrets``: array of (kind, start, end), by start, then by rule.

    A null text has an empty array. An empty table gives an empty table.
    """
    found = annotate(df, text, keep, "_kinds array<string>, _begins array<long>, _ends array<long>", _work)
    zipped = F.arrays_zip(
        F.col("_kinds").alias("kind"), F.col("_begins").alias("start"), F.col("_ends").alias("end")
    )
    return found.withColumn("secrets", zipped).drop("_kinds", "_begins", "_ends")


def _redact(texts: list[bytes | None]):
    whole = [t or b"" for t in texts]
    out = []
    for text, given, spans in zip(whole, texts, spans_of(whole)):
        pieces, at = [], 0
        for a, k, b in spans:
            if b <= at:
                continue
            pieces += [text[at : max(a, at)], b"" if a < at else f"[{RULES[k].kind}]".encode()]
            at = b
        out.append(None if given is None else b"".join([*pieces, text[at:]]).decode("utf-8", "replace"))
    return (out,)


def redact_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``keep`` columns and the text with every secret replaced by its kind in brackets.

    Overlapping spans become one mark, that of the first. A null text stays null.
    """
    return annotate(df, text, keep, f"`{text}` string", _redact)


def _digest(texts: list[bytes | None]):
    kinds, begins, finishes = _work(texts)
    counts: dict[str, list[int]] = {kind: [] for kind in BASE}
    base, every = [], []
    for k, a, b in zip(kinds, begins, finishes):
        for kind in BASE:
            counts[kind].append(k.count(kind))
        rows = [f"{x}:{y}:{z}" for x, y, z in zip(k, a, b)]
        own = ",".join(r for r, x in zip(rows, k) if x in BASE)
        base.append(hashlib.sha256(own.encode()).hexdigest())
        every.append(",".join(rows))
    return *counts.values(), base, every


def secret_report(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    return annotate(
        df, text, keep, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", _digest
    )
