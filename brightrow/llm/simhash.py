"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's bit is the majority of that bit over the hashes of all word shingles.
Equal fingerprints are one node. Nodes at up to two differing bits share a word at one bit
from both: every node emits all 65 words within half the radius (one bit), the shuffle
brings equal words together, and all who emitted one are linked to the smallest of them.
At most 65 nodes can emit the same word, so no group is large.

The odd distance, three bits, leaves at most one bit in one half of the word: there the
balls are taken per half. A half of odd parity emits its 32 neighbours, every half itself,
and the pairs that collide are verified. Pairs already in one group are not looked at. A half
of more than ``CROWDED`` fingerprints is cut further by blocks of the other half.

Texts without words (null, empty, white space) have fingerprint zero and link like any
other. Rows that repeat are members like any other. Component names are document ids;
null ids are members but name nothing.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F

from brightrow.llm.common import annotate, numbered_columns
from brightrow.llm.components import components
from brightrow.session import durable

SEED = 42
WORDS = 3
RADIUS = 3
SHINGLES_AT_ONCE = 200_000
CROWDED = 256


def _hashes(text: bytes, words: int) -> list[int]:
    parts = text.lower().split()
    if not parts:
        return []
    line = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(begins[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())
    return [digest(line[a:b], SEED) for a, b in pairs]


def fingerprints_of(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text."""
    out = np.zeros(len(texts), dtype=np.uint64)
    waiting: list[tuple[int, list[int]]] = []
    size = 0
    for i, text in enumerate(texts):
        hashes = _hashes(text, words)
        if hashes:
            waiting.append((i, hashes))
            size += len(hashes)
        if size > SHINGLES_AT_ONCE:
            _settle(waiting, out)
            waiting, size = [], 0
    _settle(waiting, out)
    return out


def _settle(waiting: list[tuple[int, list[int]]], out: np.ndarray) -> None:
    if not waiting:
        return
    sizes = np.array([len(h) for _, h in waiting], dtype=np.int64)
    every = np.concatenate([np.array(h, dtype=np.uint64) for _, h in waiting])
    bits = np.unpackbits(every.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    set_in = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)
    packed = np.packbits(2 * set_in > sizes[:, None], axis=1, bitorder="little")
    out[[i for i, _ in waiting]] = packed.view(np.uint64).ravel()


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``fp``: the fingerprint's 64 bits as a signed long."""

    def work(texts: list[bytes | None]):
        return (fingerprints_of([t or b"" for t in texts]).view(np.int64),)

    return annotate(df, text, keep, "fp long", work)


def linked(nodes: DataFrame) -> DataFrame:
    """(fp, component) for distinct ``fp``; a component is named by its smallest fingerprint.

    Nodes without a neighbour within ``RADIUS`` bits are components of their own.
    """
    flip = "explode(transform(sequence(-1, 63), i -> if(i < 0, fp, fp ^ shiftleft(1L, i)))) AS word"
    ball = nodes.select("fp", F.expr(flip))
    # Any two who emit the same word are at most two bits apart.
    shared = ball.groupBy("word").agg(F.min("fp").alias("hub"), F.max("fp").alias("other")).where("hub <> other")
    near = durable(_met(ball, shared.drop("other"), "word").where("fp <> hub").select("fp", "hub").distinct())
    groups = components(near, "fp", "hub").withColumnRenamed("node", "fp")
    first = durable(
        nodes.join(groups, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))
    )
    pairs = durable(_three_apart(first))
    merged = components(pairs, "left", "right").select(
        F.col("node").alias("component"), F.col("component").alias("whole")
    )
    return first.join(merged, "component", "left").select("fp", F.coalesce("whole", "component").alias("component"))


def _met(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """An inner join that shuffles both sides.

    Spark sizes an exploded table as if it had one row per row of its source, and would
    broadcast all words of up to its threshold of nodes.
    """
    return left.hint("merge").join(right, [*on])


def _three_apart(nodes: DataFrame) -> DataFrame:
    """Pairs of components with members three bits apart."""
    low, high = "fp & 4294967295L", "shiftrightunsigned(fp, 32)"
    halves = nodes.select("*", F.expr(f"explode(array(named_struct('side', 0L, 'half', {low}),"
                                      f" named_struct('side', 1L, 'half', {high})))").alias("h"))
    halves = halves.select("fp", "component", F.expr("shiftleft(h.side, 32) | h.half").alias("word"))
    own = halves.withColumn("exact", F.lit(True))
    odd = halves.where("bit_count(word & 4294967295L) % 2 = 1")
    flip = "explode(transform(sequence(0, 31), i -> word ^ shiftleft(1L, i))) AS word"
    around = odd.select("fp", "component", F.expr(flip), F.lit(False).alias("exact"))
    right = own.unionByName(around).select(
        "word", F.col("fp").alias("other"), F.col("component").alias("right"), "exact"
    )
    left = halves.select("word", "fp", F.col("component").alias("left"))
    hit = f"left <> right AND bit_count(fp ^ other) <= {RADIUS} AND (NOT exact OR fp < other)"
    crowded = durable(left.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("word"))
    if crowded.isEmpty():
        return _met(left, right, "word").where(hit).select("left", "right").distinct()
    few = _met(left.join(crowded, "word", "leftanti"), right, "word").where(hit).select("left", "right")
    many = _met(
        _cut(left.join(crowded, "word", "leftsemi"), "fp"),
        _cut(right.join(crowded, "word", "leftsemi"), "other"),
        "word",
        "block",
    )
    return few.union(many.where(hit).select("left", "right")).distinct()


def _cut(rows: DataFrame, fp: str) -> DataFrame:
    """The rows once per ``block`` of eight bits of the half that is not in ``word``.

    At most three bits of the four blocks differ, so one block of a pair is equal.
    """
    rest = f"if(shiftrightunsigned(word, 32) = 0, shiftrightunsigned({fp}, 32), {fp} & 4294967295L)"
    blocks = f"explode(transform(sequence(0, 3), i -> i * 256 + (shiftrightunsigned({rest}, 8 * i) & 255))) AS block"
    return rows.select("*", F.expr(blocks))


def keep_one(df: DataFrame, text: str = "text", by: str = "doc_id") -> DataFrame:
    """One row of each component, all columns: that of the smallest id, then text digest, null ids last.

    Of rows equal in id and text one stays.
    """
    names = df.columns
    plain = numbered_columns(df)
    id_, body = F.col(f"_{names.index(by)}"), F.col(f"_{names.index(text)}")
    none = F.lit("none")
    key = F.md5(F.concat_ws(" ", F.coalesce(id_.cast("string"), none), F.coalesce(F.md5(body), none)))
    keyed = plain.withColumn("_key", key)
    rows = durable(fingerprints(keyed.select(id_.alias("id"), "_key", body.alias("text")), "text", ("id", "_key")))
    groups = durable(linked(rows.select("fp").distinct()))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "_key")
    stay = rows.join(groups, "fp").groupBy("component").agg(F.min(order).alias("first")).select("first._key")
    kept = keyed.join(durable(stay), "_key", "leftsemi").dropDuplicates(["_key"])
    return kept.drop("_key").toDF(*names)


def near_duplicates(df: DataFrame, text: str = "text", by: str = "doc_id") -> DataFrame:
    """Per row: its id, fingerprint (16 hex digits) and the smallest id of its component."""
    rows = durable(fingerprints(df, text, (by,)))
    nodes = durable(rows.groupBy("fp").agg(F.min(by).alias("first")))
    groups = durable(linked(nodes.select("fp")))
    named = groups.join(nodes, "fp")
    names = durable(named.groupBy("component").agg(F.min("first").alias("component_id")))
    found = durable(groups.join(names, "component").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(found, "fp").select(F.col(by), hexed, "component_id")
