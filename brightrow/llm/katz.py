"""Language-model scoring: bigram Katz backoff over words.

A seen pair has its Good-Turing discounted share, P(w|v) = d(c) c(vw) / c(v); any other
word after v has a(v) P(w), where P(w) is the Good-Turing unigram share and a(v) is set
so that all words and the unknown word sum to one exactly. The unknown word has the
Good-Turing mass of unseen words. Counts up to ``CUT`` are discounted; where a context
has no discounted count, one more is put under its shares.

Documents are cut into blocks, each with its distinct words and pairs. The count tables
are partitioned: blocks send their words, then their pairs with counts, to the shard
that owns them; the shard adds up and answers with the totals. A pair belongs to the
shard of its first word, which so knows all that follows it; a word with a large part of
all pairs (``c(v)`` above a threshold, so at most four per shard) is spread by the second
word, and its sums are added up apart. What a block and a shard exchange is one row of
packed arrays, at most one row per distinct pair of a block. Blocks are bucketed by
their name, so that the answers come to them and they are not shuffled.

The first word of a text follows a start mark, and every text ends in an end token. Null
and empty texts are the end token alone. Words are known by 64-bit hashes. Rows that
repeat give the same result each and count each. An empty table gives an empty table.
Memory is bounded by ``BLOCK_TOKENS`` and by the shard size, not by the corpus; a single
text is one block at least, whole at any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from brightrow.llm.common import as_bytes, batches, pick, to_arrow
from brightrow.llm.exchange import bucketed, pack, pack_sorted, shard_of, unpack, unpack_sorted
from brightrow.session import durable

CUT = 5
BLOCK_TOKENS = 2_000_000
SHARD_BYTES = 16_000_000
MOST_SHARDS = 65_536
END, START = xxhash.xxh64_intdigest(b""), xxhash.xxh64_intdigest(b"\n")
STATS = CUT + 2  # counts of 1 to CUT + 1, and the total


# Blocks


def _blocks(df: DataFrame, text: str, by: str) -> DataFrame:
    """Tokenized documents, many to a row: ids, held_out, and packed sizes, tokens and word hashes."""
    ids = T.ArrayType(df.schema[by].dataType)
    schema = T.StructType(
        [
            T.StructField("block", T.StringType()),
            T.StructField("ids", ids),
            T.StructField("held", T.ArrayType(T.BooleanType())),
            *[T.StructField(c, T.BinaryType()) for c in ("sizes", "tokens", "words")],
        ]
    )

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        block = _Block()
        for chunk in chunks:
            names = chunk.column(chunk.schema.get_field_index(by))
            held = chunk.column(chunk.schema.get_field_index("held"))
            begin = 0
            for i, t in enumerate(as_bytes(chunk.column(chunk.schema.get_field_index(text)))):
                block.add(t or b"")
                if block.size >= BLOCK_TOKENS:
                    block.named(names.slice(begin, i + 1 - begin), held.slice(begin, i + 1 - begin))
                    yield block.row(f"{part}-{number}")
                    block, number, begin = _Block(), number + 1, i + 1
            block.named(names.slice(begin), held.slice(begin))
        if block.size:
            yield block.row(f"{part}-{number}")

    return batches(df.select(by, text, "held"), run, schema)


class _Block:
    def __init__(self):
        self.places: dict[bytes, int] = {b"": 0}  # the end token
        self.tokens: list[np.ndarray] = []
        self.size = 0
        self.ids: list[pa.Array] = []
        self.held: list[pa.Array] = []

    def add(self, text: bytes) -> None:
        words = text.lower().split()
        at = np.fromiter(map(self.places.get, words, repeat(-1)), dtype=np.int64, count=len(words) + 0)
        for i in np.flatnonzero(at < 0).tolist():
            at[i] = self.places.setdefault(words[i], len(self.places))
        self.tokens.append(np.append(at, 0).astype(np.int32))
        self.size += len(words) + 1

    def named(self, ids: pa.Array, held: pa.Array) -> None:
        self.ids.append(ids)
        self.held.append(held)

    def row(self, name: str) -> pa.RecordBatch:
        keys = np.fromiter(map(xxhash.xxh64_intdigest, self.places), dtype=np.uint64, count=len(self.places))
        keys, place = np.unique(keys, return_inverse=True)
        sizes = np.array([len(t) for t in self.tokens])
        tokens = place[np.concatenate(self.tokens)]
        listed = lambda arrays: pa.ListArray.from_arrays(
            pa.array([0, len(sizes)], type=pa.int32()), pa.concat_arrays(arrays)
        )
        columns = [
            pa.array([name]),
            listed(self.ids),
            listed(self.held),
            pa.array([pack(sizes, "<u4")]),
            pa.array([pack(tokens, "<u4")]),
            pa.array([pack_sorted(keys)]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "held", "sizes", "tokens", "words"])


def _training(held: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Per token: whether its document is one to learn from."""
    return np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), sizes)


def _read(row: pa.Table) -> tuple[np.ndarray, ...]:
    """sizes, tokens, word hashes and training mask of a block's row."""
    sizes = unpack(row.column("sizes")[0].as_py(), "<u4").astype(np.int64)
    tokens = unpack(row.column("tokens")[0].as_py(), "<u4").astype(np.int64)
    words = unpack_sorted(row.column("words")[0].as_py())
    held = row.column("held").combine_chunks().flatten()
    return sizes, tokens, words, _training(held, sizes)


# Words


def _word_requests(blocks: DataFrame, shards: int) -> DataFrame:
    def run(chunks):
        for chunk in chunks:
            for i in range(chunk.num_rows):
                row = pa.Table.from_batches([chunk.slice(i, 1)])
                _, tokens, words, train = _read(row)
                counts = np.bincount(tokens[train], minlength=len(words))
                shard = shard_of(words, shards)
                used, first = np.unique(shard, return_index=True)
                cuts = [*first.tolist(), len(words)]
                parts = list(zip(cuts[:-1], cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used.astype(np.int32)),
                        pa.array([row.column("block")[0].as_py()] * len(used)),
                        pa.array([pack_sorted(words[a:b]) for a, b in parts]),
                        pa.array([pack(counts[a:b], "<u4") for a, b in parts]),
                    ],
                    names=["shard", "block", "words", "counts"],
                )

    return batches(blocks.select("block", "held", "sizes", "tokens", "words"), run, "shard int, block string, words binary, counts binary")


ANSWER = "shard int, block string, hot boolean, counts binary, seen binary, stats array<long>, word long, mass double"


def _answer(shard, block=None, hot=None, counts=None, seen=None, stats=None, word=None, mass=None) -> dict:
    return locals()


_ANSWER_KINDS = {
    "shard": pa.int32(),
    "block": pa.string(),
    "hot": pa.bool_(),
    "counts": pa.binary(),
    "seen": pa.binary(),
    "stats": pa.list_(pa.int64()),
    "word": pa.int64(),
    "mass": pa.float64(),
}


def _answers(rows: list[dict]) -> pa.Table:
    return pa.table({n: pa.array([r[n] for r in rows], type=t) for n, t in _ANSWER_KINDS.items()})


def _frequencies(totals: np.ndarray) -> list[int]:
    """How many counts are 1 to CUT + 1, and the total of all."""
    found = np.bincount(np.minimum(totals, CUT + 2), minlength=CUT + 3)
    return [*found[1 : CUT + 2].tolist(), int(totals.sum())]


def _merge_words(group: pa.Table) -> pa.Table:
    shard = group.column("shard")[0].as_py()
    keys = [unpack_sorted(x) for x in group.column("words").to_pylist()]
    counts = [unpack(x, "<u4") for x in group.column("counts").to_pylist()]
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
    rows, at = [], 0
    for block, own in zip(group.column("block").to_pylist(), keys):
        rows.append(_answer(shard, block, counts=pack(totals[place[at : at + len(own)]], "<u8")))
        at += len(own)
    rows.append(_answer(shard, stats=[*_frequencies(totals), int((totals > 0).sum())]))
    return _answers(rows)


# Discounts


def discounts(frequencies: list[int]) -> np.ndarray:
    """Katz's discount per count 0 to CUT (0 unused); one where the frequencies give none."""
    n = [0, *frequencies]
    out = np.ones(CUT + 1)
    rest = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    for r in range(1, CUT + 1):
        if n[1] and n[r] and rest < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
            out[r] = d if 0 < d < 1 else 1.0
    return out


class Unigrams:
    """Discounted shares of words; unseen words together have what is left."""

    def __init__(self, frequencies: list[int], tokens: int, distinct: int):
        self.tokens, self.distinct = tokens, distinct
        self.discount = discounts(frequencies)
        lost = sum(frequencies[r - 1] * r * (1 - self.discount[r]) for r in range(1, CUT + 1))
        self.total = tokens if lost > 0 else tokens + 1
        self.unknown = (lost if lost > 0 else 1) / self.total

    def shares(self, counts: np.ndarray) -> np.ndarray:
        kept = np.append(self.discount, 1.0)[np.minimum(counts, CUT + 1)]
        return np.where(counts > 0, kept * counts / self.total, self.unknown)


# Pairs


class _Pairs:
    """Distinct (previous, word) of a block in the order in which shards get them."""

    def __init__(self, sizes, tokens, words, counts, hot_from: int, shards: int):
        start = len(words)  # the start mark comes after all words
        previous = np.empty(len(tokens), dtype=np.int64)
        previous[1:] = tokens[:-1]
        previous[np.cumsum(sizes) - sizes] = start
        codes, self.place = np.unique(previous * (start + 1) + tokens, return_inverse=True)
        v, self.w = codes // (start + 1), codes % (start + 1)
        end = int(np.searchsorted(words, np.uint64(END)))
        keys = np.append(words, np.uint64(START))
        self.context = np.append(counts, counts[end])[v]  # as often as a text begins, one ends
        hot = self.context >= hot_from
        shard = np.where(hot, shard_of(keys[self.w], shards), shard_of(keys[v], shards))
        order = np.lexsort((v, hot, shard))
        self.place = np.argsort(order)[self.place]
        self.v_key, self.w_key = keys[v][order], keys[self.w][order]
        self.w, self.context, hot, shard = self.w[order], self.context[order], hot[order], shard[order]
        part = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (hot[1:] != hot[:-1])]))
        self.parts = list(zip(part.tolist(), [*part[1:].tolist(), len(order)]))
        self.shard, self.hot = shard, hot


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal neighbours begin, and how long they are."""
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return begin, np.diff(np.append(begin, len(keys)))


def _counts_of(answers: pa.Table) -> np.ndarray:
    rows = sorted(zip(answers.column("shard").to_pylist(), answers.column("counts").to_pylist()))
    return np.concatenate([unpack(c, "<u8") for _, c in rows]).astype(np.int64)


def _request_pairs(hot_from: int, shards: int):
    def run(key, block: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["shard", "block", "hot", "v", "runs", "w", "counts", "word_counts"]
        kinds = [pa.int32(), pa.string(), pa.bool_(), *[pa.binary()] * 5]
        sizes, tokens, words, train = _read(block)
        counts = _counts_of(answers)
        pairs = _Pairs(sizes, tokens, words, counts, hot_from, shards)
        own = np.bincount(pairs.place[train], minlength=len(pairs.w))
        rows = []
        for a, b in pairs.parts:
            begin, size = _runs(pairs.v_key[a:b])
            rows.append(
                (
                    int(pairs.shard[a]),
                    key[0].as_py(),
                    bool(pairs.hot[a]),
                    pack(pairs.v_key[a:b][begin], "<u8"),
                    pack(size, "<u4"),
                    pack(pairs.w_key[a:b], "<u8"),
                    pack(own[a:b], "<u4"),
                    pack(counts[pairs.w[a:b]], "<u8"),
                )
            )
        return pa.table({n: pa.array([r[i] for r in rows], type=t) for i, (n, t) in enumerate(zip(names, kinds))})

    return run


def _merge_pairs(unigrams: Unigrams):
    def run(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        parts = {c: group.column(c).to_pylist() for c in ("block", "hot", "v", "runs", "w", "counts", "word_counts")}
        heads = [unpack(x, "<u8") for x in parts["v"]]
        runs = [unpack(x, "<u4") for x in parts["runs"]]
        v = np.concatenate([np.repeat(h, r) for h, r in zip(heads, runs)])
        w = np.concatenate([unpack(x, "<u8") for x in parts["w"]])
        n = np.concatenate([unpack(x, "<u4") for x in parts["counts"]])
        in_words = np.concatenate([unpack(x, "<u8") for x in parts["word_counts"]]).astype(np.int64)
        mixed = v * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) + w * np.uint64(0xBF58476D1CE4E5B9)
        _, first, place = np.unique(mixed, return_index=True, return_inverse=True)
        totals = np.bincount(place, weights=n).astype(np.int64)
        hot = np.repeat(np.array(parts["hot"], dtype=bool), [int(r.sum()) for r in runs])
        # Per first word: how many pairs have each small count, and the unigram mass of all seen.
        seen = totals > 0
        context, at = np.unique(v[first], return_inverse=True)
        table = np.zeros((len(context), CUT))
        small = seen & (totals <= CUT)
        np.add.at(table, (at[small], totals[small] - 1), 1)
        share = unigrams.shares(in_words[first])
        mass = np.bincount(at[seen], weights=share[seen], minlength=len(context))
        rows, done = [], 0
        for block, is_hot, head, run_sizes in zip(parts["block"], parts["hot"], heads, runs):
            size = int(run_sizes.sum())
            answer = _answer(shard, block, is_hot, counts=pack(totals[place[done : done + size]], "<u8"))
            if not is_hot:
                row = np.searchsorted(context, head)
                answer["seen"] = pack(np.column_stack([table[row], mass[row]]).T.ravel(), "<f8")
            rows.append(answer)
            done += size
        for i in np.unique(at[hot[first]]).tolist():
            rows.append(
                _answer(shard, hot=True, stats=table[i].astype(np.int64).tolist(), word=int(context[i].astype(np.int64)), mass=float(mass[i]))
            )
        rows.append(_answer(shard, hot=False, stats=_frequencies(totals)))
        return _answers(rows)

    return run


def _score(unigrams: Unigrams, discount: np.ndarray, hot: dict, hot_from: int, shards: int, by: str, schema: T.StructType):
    kinds = to_arrow(T.StructType(schema.fields[1:]))

    def run(key, block: pa.Table, answers: pa.Table) -> pa.Table:
        sizes, tokens, words, _ = _read(block)
        of_words = answers.filter(pc.is_null(answers.column("hot")))
        of_pairs = answers.filter(pc.is_valid(answers.column("hot"))).to_pylist()
        counts = _counts_of(of_words)
        pairs = _Pairs(sizes, tokens, words, counts, hot_from, shards)
        total = np.zeros(len(pairs.w), dtype=np.int64)
        weight = np.ones(len(pairs.w))  # of the shorter context
        spare = np.zeros(len(pairs.w), dtype=bool)  # contexts with one more under their shares
        by_part = {(r["shard"], r["hot"]): r for r in of_pairs}
        for a, b in pairs.parts:
            answer = by_part[int(pairs.shard[a]), bool(pairs.hot[a])]
            total[a:b] = unpack(answer["counts"], "<u8")
            begin, size = _runs(pairs.v_key[a:b])
            if pairs.hot[a]:
                stats = np.array([hot[int(k.astype(np.int64))] for k in pairs.v_key[a:b][begin]])
            else:
                stats = unpack(answer["seen"], "<f8").reshape(CUT + 1, -1).T
            known = pairs.context[a:b][begin].astype(np.float64)
            lost = stats[:, :CUT] @ (np.arange(1, CUT + 1) * (1 - discount[1:]))
            none = lost <= 0
            free = np.where(none, 1 / (known + 1), lost / np.maximum(known, 1))
            factor = free / np.maximum(1 - stats[:, CUT], unigrams.unknown)
            weight[a:b] = np.repeat(np.where(known > 0, factor, 1.0), size)
            spare[a:b] = np.repeat(none, size)
        kept = np.append(discount, 1.0)[np.minimum(total, CUT + 1)]
        share = kept * total / np.maximum(pairs.context + spare, 1)
        share = np.where(total > 0, share, weight * unigrams.shares(counts[pairs.w]))
        first = np.cumsum(sizes) - sizes
        logs = np.log10(share)[pairs.place]
        base = np.log10((counts + 1) / (unigrams.tokens + unigrams.distinct + 1))[tokens]
        held = block.column("held").combine_chunks().flatten()
        found = [
            held,
            sizes,
            np.add.reduceat((counts > 0)[tokens].astype(np.int64), first),
            np.full(len(sizes), unigrams.tokens),
            np.add.reduceat(base, first),
            np.add.reduceat(logs, first),
        ]
        ids = block.column("ids").combine_chunks().flatten()
        return pa.table([ids, *[pa.array(x, type=t) for x, t in zip(found, kinds)]], names=schema.names)

    return run


def score_texts(df: DataFrame, held_out: Column, text: str = "text", by: str = "doc_id") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    The model learns from all rows that are not held out: a condition on the id and the
    text, where null counts as false. ``base_score`` is the sum of the add-one unigram logarithms.
    """
    docs = pick(df, by, text).select(by, text, F.coalesce(held_out, F.lit(False)).alias("held"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = min(MOST_SHARDS, max(4, math.ceil(size / SHARD_BYTES)))
    blocks = bucketed(_blocks(docs, text, by), shards)
    words = durable(_word_requests(blocks, shards).groupBy("shard").applyInArrow(_merge_words, ANSWER))
    sums = [F.sum(F.col("stats")[i]) for i in range(STATS + 1)]
    row = [x or 0 for x in words.where("block is null").agg(*sums).first()]
    unigrams = Unigrams([int(x) for x in row[: CUT + 1]], int(row[CUT + 1]), int(row[CUT + 2]))
    hot_from = max(1, math.ceil(unigrams.tokens / (4 * shards)))
    to_blocks = words.where("block is not null")
    requests = blocks.groupBy("block").cogroup(to_blocks.groupBy("block")).applyInArrow(
        _request_pairs(hot_from, shards),
        "shard int, block string, hot boolean, v binary, runs binary, w binary, counts binary, word_counts binary",
    )
    pairs = durable(requests.groupBy("shard").applyInArrow(_merge_pairs(unigrams), ANSWER))
    row = [x or 0 for x in pairs.where("block is null and not hot").agg(*sums[:STATS]).first()]
    discount = discounts([int(x) for x in row[: CUT + 1]])
    # At most four words a shard have so many pairs.
    own = pairs.where("block is null and hot").groupBy("word")
    found = own.agg(*[F.sum(F.col("stats")[i]) for i in range(CUT)], F.sum("mass")).collect()
    hot = {r[0]: [float(x) for x in r[1:]] for r in found}
    schema = T.StructType(
        [T.StructField(by, docs.schema[by].dataType)]
        + T.StructType.fromDDL(
            "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        ).fields
    )
    answers = to_blocks.unionByName(pairs.where("block is not null"))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(unigrams, discount, hot, hot_from, shards, by, schema), schema
    )
