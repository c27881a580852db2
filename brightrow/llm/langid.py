"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts with the counts of what followed them. A byte
costs what PPM (method C, with exclusion) gives it: in the longest known context its
share, or an escape and the next shorter context, down to all 256 bytes alike. The
statistics are frozen after training, so the cost of a byte depends only on the longest
context that any language knows. These contexts are the states of an automaton: costs and
moves are tables, and whole buffers are scored in array steps (``automaton.run``). The
language with the shortest code wins.

Training reads a sample of at most ``SAMPLE_DOCUMENTS`` documents per language, chosen by a
hash of id and text. A document of more than ``SAMPLE_PIECES`` pieces of ``PIECE`` characters
gives so many pieces from all over its text, also chosen by hashes. Each language is counted
in a task of its own, and the driver gets only the finished costs. The trees keep contexts
seen at least ``LEAST`` times, at most ``MOST_STATES`` in all. At most ``MOST_LANGUAGES``
values are learned, those with the most labelled rows (ties by name); a warning tells if
there are more. So the model is bounded whatever the corpus or its labels hold.

Null texts and texts without a letter are ``und`` with score 0. Rows that repeat give the
same result each, and count once in training. Texts are scored whole at any length. Without
any training text all are ``und``.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from brightrow.llm import automaton
from brightrow.llm.common import annotate, groups, joined, pick
from brightrow.llm.automaton import SEPARATOR
from brightrow.session import durable

UNKNOWN = "und"
ORDER = 4
LEAST = 24
MOST_STATES = 6_000
SAMPLE_DOCUMENTS = 300
SAMPLE_PIECES = 8
PIECE = 1_000
MOST_LANGUAGES = 32
SHARES = 64


class Layout:
    """The states of the automaton, the classes of bytes, and where each byte leads."""

    def __init__(self, kept: set[bytes], seen: list[int]):
        self.states = {c: i for i, c in enumerate(sorted(kept, key=lambda c: (len(c), c)))}
        # Bytes that no training text holds cost the same everywhere and share a class.
        self.classes = np.zeros(256, dtype=np.int64)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        unseen = [b for b in range(256) if not self.classes[b]]
        self.members = [(unseen or [0])[0], *seen]

    def moves(self) -> np.ndarray:
        table = np.zeros((len(self.states), self.width), dtype=np.int32)
        for context, state in self.states.items():
            for k, member in enumerate(self.members):
                after = context + bytes([member]) if k else b""
                while after not in self.states:
                    after = after[1:]
                table[state, k] = self.states[after] * self.width
        return table.ravel()

    def costs(self, tree: dict[bytes, dict[int, int]]) -> np.ndarray:
        """Bits per state and class under one language's tree."""
        out = np.zeros((len(self.states), self.width), dtype=np.float32)
        for context, state in self.states.items():
            out[state] = -np.log2(_shares(tree, context))[self.members]
        return out.ravel()


class Model:
    """Moves between contexts and the cost in bits of every byte, per context and language."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER, least: int = LEAST):
        """Fit on small samples at hand; ``train`` does the same on a table."""
        trees = {x: _contexts(samples[x], order) for x in samples}
        seen = sorted({b for texts in samples.values() for t in texts for b in t})
        layout = Layout(_kept(list(trees.values()), least), seen)
        self._hold(layout, {x: layout.costs(tree) for x, tree in trees.items()})

    @classmethod
    def of(cls, layout: Layout, costs: dict[str, np.ndarray]) -> Model:
        model = cls.__new__(cls)
        model._hold(layout, costs)
        return model

    def _hold(self, layout: Layout, costs: dict[str, np.ndarray]) -> None:
        self.languages = sorted(costs)
        self.states, self.classes, self.width = layout.states, layout.classes, layout.width
        self.table = layout.moves()
        self.cost = np.empty((len(self.table), len(costs)), dtype=np.float32)
        for j, x in enumerate(self.languages):
            self.cost[:, j] = costs[x]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        classes = self.classes.copy()
        for low, high in groups(texts):
            data, starts = joined(texts[low:high], bytes([SEPARATOR]))
            states = automaton.run(self.table, classes, data)
            before = np.concatenate([[0], states[:-1]])
            at = before + classes[data]
            at[starts[1:] - 1] = 0
            ends = starts[1:] - 1
            for j in range(len(self.languages)):
                total = np.concatenate([[0.0], np.cumsum(self.cost[at, j], dtype=np.float64)])
                out[low:high, j] = total[ends] - total[starts[:-1]]
        return out


def _contexts(texts: list[bytes], order: int) -> dict[bytes, Counter]:
    """What follows each context of up to ``order`` bytes."""
    out: dict[bytes, Counter] = {}
    for k in range(order + 1):
        grams: Counter = Counter()
        for t in texts:
            grams.update(t[i : i + k + 1] for i in range(len(t) - k))
        for g, n in grams.items():
            out.setdefault(g[:-1], Counter())[g[-1]] = n
    out.setdefault(b"", Counter())
    return out


def _kept(counts: list[dict[bytes, Counter]], least: int) -> set[bytes]:
    """Frequent contexts with all their suffixes, so that a shorter context is always there."""
    total: Counter = Counter()
    for tree in counts:
        for context, followers in tree.items():
            total[context] = max(total[context], sum(followers.values()))
    kept = {b""}
    for context, n in sorted(total.items(), key=lambda x: (-x[1], len(x[0]), x[0])):
        chain = {context[i:] for i in range(len(context) + 1)}
        if n >= least and len(kept | chain) <= MOST_STATES:
            kept |= chain
    return kept


def _shares(tree: dict[bytes, dict[int, int]], context: bytes) -> np.ndarray:
    """Probability of each of the 256 bytes after ``context``; they sum to one."""
    share = np.zeros(256)
    free = np.ones(256, dtype=bool)
    left = 1.0
    for i in range(len(context) + 1):
        followers = tree.get(context[i:])
        if not followers:
            continue
        seen = np.zeros(256)
        seen[list(followers)] = list(followers.values())
        seen[~free] = 0
        different = np.count_nonzero(seen)
        if not different:
            continue
        full = different == np.count_nonzero(free)
        total = seen.sum() + (0 if full else different)
        share += left * seen / total
        left *= different / total if not full else 0.0
        free &= seen == 0
        if full:
            return share
    share[free] = left / np.count_nonzero(free)
    return share


def _names(rows: DataFrame, language: str) -> list[str]:
    """The languages to learn."""
    labelled = rows.where(F.col(language).isNotNull()).groupBy(language).count()
    found = labelled.orderBy(F.desc("count"), language).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        warnings.warn(f"{language} has more than {MOST_LANGUAGES} values; the most frequent are learned")
    return [r[0] for r in found[:MOST_LANGUAGES]]


def sample(df: DataFrame, language: str = "lang", text: str = "text", by: str = "doc_id") -> DataFrame:
    """Columns _lang and _part: what ``train`` learns from."""
    rows = pick(df, by, language, text)
    rows = rows.where(F.col(language).isin(_names(rows, language)) & (F.length(text) > 0))
    hashed = F.xxhash64(F.col(by).cast("string"), F.col(text))
    keys = rows.select(F.col(language).alias("_lang"), hashed.alias("_hash")).distinct()
    # A language may hold most rows: its hashes are thinned in shares first.
    share = F.pmod("_hash", F.lit(SHARES))
    first = Window.partitionBy("_lang", share).orderBy("_hash")
    final = Window.partitionBy("_lang").orderBy("_hash")
    for window in (first, final):
        keys = keys.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= SAMPLE_DOCUMENTS)
    chosen = durable(keys.select("_lang", "_hash"))
    known = rows.select(F.col(language).alias("_lang"), hashed.alias("_hash"), F.col(text).alias("_text"))
    # Texts are read again rather than shuffled; languages and documents of each are bounded.
    found = known.join(F.broadcast(chosen), ["_lang", "_hash"], "leftsemi")
    cut = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    ranked = F.transform(cut, lambda part, i: F.struct(F.xxhash64("_hash", i).alias("rank"), part.alias("part")))
    spread = F.slice(F.array_sort(ranked), 1, SAMPLE_PIECES)["part"]
    parts = F.when(F.length("_text") <= SAMPLE_PIECES * PIECE, F.array("_text")).otherwise(spread)
    once = found.select("_lang", "_hash", parts.alias("_parts")).groupBy("_lang", "_hash").agg(F.first("_parts").alias("_parts"))
    return once.select("_lang", F.explode("_parts").alias("_part"))


def _count(group: pa.Table) -> pa.Table:
    """The tree of one language, a row per context."""
    tree = _contexts([t.encode() for t in group.column("_part").to_pylist()], ORDER)
    return pa.table(
        {
            "_lang": pa.array([group.column("_lang")[0].as_py()] * len(tree), type=pa.string()),
            "context": pa.array(list(tree), type=pa.binary()),
            "total": pa.array([sum(x.values()) for x in tree.values()], type=pa.int64()),
            "followers": pa.array([bytes(x) for x in tree.values()], type=pa.binary()),
            "counts": pa.array([np.array(list(x.values()), dtype="<u4").tobytes() for x in tree.values()], type=pa.binary()),
        }
    )


def train(df: DataFrame, language: str = "lang", text: str = "text", by: str = "doc_id") -> Model:
    """Fit on the rows with a language and a text; see the module on the sample."""
    # A group holds one language's sample, or its tree, which the sample bounds.
    counted = sample(df, language, text, by).groupBy("_lang").applyInArrow(
        _count, "_lang string, context binary, total long, followers binary, counts binary"
    )
    trees = durable(counted)
    size = F.length("context")
    often = trees.groupBy("context").agg(F.max("total").alias("total")).where((F.col("total") >= LEAST) | (size == 0))
    kept = often.orderBy(F.desc("total"), size, "context").limit(MOST_STATES).select("context").collect()
    seen = trees.where(size == 0).select("followers").collect()
    layout = Layout({b"", *[bytes(r[0]) for r in kept]}, sorted({b for r in seen for b in r[0]}))
    states = df.sparkSession.createDataFrame([(c,) for c in layout.states], "context binary")

    def cost(group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_pylist() for c in ("context", "followers", "counts")]
        tree = {c: dict(zip(f, np.frombuffer(n, dtype="<u4").tolist())) for c, f, n in zip(*columns)}
        found = [layout.costs(tree).tobytes()]
        return pa.table({"_lang": group.column("_lang").slice(0, 1), "cost": pa.array(found, type=pa.binary())})

    used = trees.join(F.broadcast(states), "context", "leftsemi")
    rows = used.groupBy("_lang").applyInArrow(cost, "_lang string, cost binary").collect()
    return Model.of(layout, {r[0]: np.frombuffer(r["cost"], dtype=np.float32) for r in rows})


_ASCII = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def letters(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with has_letter, false for null."""

    def work(texts: list[bytes | None]):
        return ([bool(t) and has_letter(t) for t in texts],)

    return annotate(df, text, keep, "has_letter boolean", work)


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with lang_pred, score (posterior under equal priors) and bits per byte."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_STATES and MOST_LANGUAGES

    def work(texts: list[bytes | None]):
        fitted = shared.value
        good = [i for i, t in enumerate(texts) if t and fitted.languages and has_letter(t)]
        names: list[str] = [UNKNOWN] * len(texts)
        scores, bits = [0.0] * len(texts), [None] * len(texts)
        if good:
            lengths = fitted.code_lengths([texts[i] for i in good])
            best = lengths.argmin(axis=1)
            least = lengths[np.arange(len(good)), best]
            share = 1.0 / np.exp2(np.maximum(least[:, None] - lengths, -1000.0)).sum(axis=1)
            for i, b, s, n in zip(good, best, share.tolist(), least.tolist()):
                names[i], scores[i], bits[i] = fitted.languages[b], s, n / len(texts[i])
        return names, scores, bits

    return annotate(df, text, keep, "lang_pred string, score double, bits_per_byte double", work)
