"""Best-fit packing of tokenized documents into fixed-length sequences.

Every document is cut into pieces of at most ``capacity`` tokens. Best-fit decreasing takes
pieces from long to short and puts each into the fullest sequence that still has room.
Which piece of a length it is makes no difference, so the packing is settled on the
number of pieces per length (at most ``capacity`` numbers): a segment tree over the
remaining capacities gives the tightest open sequences, and all pieces of a length that
go to sequences of one capacity are placed together. The result equals that of the
one-by-one method. The plan is a list of runs (length, first piece, first sequence,
offset, size), at most some thousands whatever the number of documents.

Pieces are numbered per length by bucket, so that a length that a third of all pieces
share is spread over tasks; a bucket and length then start where the counts before end.

A null or empty text is the end token alone. Rows that repeat are packed once each. An
empty table gives an empty table.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import zlib
from collections import deque
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from brightrow.llm.common import annotate, batches, groups, ragged
from brightrow.session import durable

CAPACITY = 2048
END_ID = 0
ROWS_PER_BUCKET = 200_000
CACHED_WORDS = 800_000


# Signs after a letter and before white space are a pre-token of their own.
_SIGNS = re.compile(rb"(?<=[a-z])([.,!?;:]+)(?=[ \t\n\r])")
# Pre-tokens of an ASCII word in lower case, as the vocabulary's pattern cuts it.
_ASCII_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\sa-z0-9]+")
WORDS_AT_ONCE = 100


def _parts(word: str) -> int:
    """Number of pre-tokens, or 0 where it is not plain."""
    if word.isalpha():
        return int("İ" not in word and unicodedata.is_normalized("NFC", word))
    return len(_ASCII_PARTS.findall(word.lower())) if word.isascii() and "<|" not in word else 0


class Vocabulary:
    """Ids of a text by a tokenizer that ignores case and never looks across white space.

    Each distinct word is encoded once and kept; the store is emptied when it is full.
    New words are encoded many at a time and cut apart by their number of pre-tokens,
    each of which ends in a token with the vocabulary's word end; words whose number is
    not plain, or a group whose numbers do not add up, are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, dtype=bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.places: dict[bytes, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.used = 0
        self.starts = np.empty(1 << 16, dtype=np.int64)
        self.sizes = np.empty(1 << 16, dtype=np.int64)

    def _learn(self, words: list[bytes]) -> None:
        decoded = [w.decode("utf-8", "replace") for w in words]
        parts = list(map(_parts, decoded))
        plain = [i for i, n in enumerate(parts) if n]
        single = [i for i, n in enumerate(parts) if not n]
        chunks = [plain[i : i + WORDS_AT_ONCE] for i in range(0, len(plain), WORDS_AT_ONCE)]
        found = self._ids([" ".join([decoded[i] for i in chunk]) for chunk in chunks])
        for chunk, ids in zip(chunks, found):
            ends = np.flatnonzero(self.ends[ids]) + 1
            upto = np.cumsum([parts[i] for i in chunk])
            if len(ends) != upto[-1]:
                single += chunk
                continue
            self._keep([words[i] for i in chunk], ids, ends[upto - 1])
        if single:
            found = self._ids([decoded[i] for i in single])
            self._keep([words[i] for i in single], np.concatenate(found), np.cumsum([len(ids) for ids in found]))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint32) for x in found]

    def _keep(self, words: list[bytes], ids: np.ndarray, ends) -> None:
        known, end = len(self.places), np.asarray(ends, dtype=np.int64)
        self.flat = _room(self.flat, self.used + len(ids))
        self.starts = _room(self.starts, known + len(words))
        self.sizes = _room(self.sizes, known + len(words))
        self.flat[self.used : self.used + len(ids)] = ids
        self.places.update(zip(words, range(known, known + len(words))))
        begin = np.concatenate([[0], end[:-1]])
        self.starts[known : known + len(words)] = self.used + begin
        self.sizes[known : known + len(words)] = end - begin
        self.used += len(ids)

    def _look_up(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.places.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids per text; new words of many texts are learnt together."""
        out: list[np.ndarray] = []
        for low, high in groups(texts):
            if len(self.places) > CACHED_WORDS:
                self._clear()
            words = [_split(t) for t in texts[low:high]]
            found = [self._look_up(own) for own in words]
            missing = {own[i] for own, at in zip(words, found) for i in np.flatnonzero(at < 0).tolist()}
            if missing:
                self._learn(list(missing))
            for own, at in zip(words, found):
                new = np.flatnonzero(at < 0)
                at[new] = self._look_up([own[i] for i in new.tolist()])
                out.append(self.flat[ragged(self.starts[at], self.sizes[at])])
        return out


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, grown by doubling if it is shorter than ``size``."""
    if size <= len(array):
        return array
    grown = np.empty(max(size, 2 * len(array)), dtype=array.dtype)
    grown[: len(array)] = array
    return grown


def _split(text: bytes) -> list[bytes]:
    # Special strings keep their case, which tells them from ordinary text.
    return text.split() if b"<|" in text else _SIGNS.sub(rb" \1", text.lower()).split()


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pieces(
    df: DataFrame,
    tokenizer: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: the ``keep`` columns, piece, start, length and the CRC-32 of its ids."""

    def work(texts: list[bytes | None]):
        store = vocabulary(tokenizer)
        starts, lengths, checks = [], [], []
        for found in store.encode([t or b"" for t in texts]):
            ids = np.append(found, np.uint32(end_id)).astype("<u4")
            cuts = range(0, len(ids), capacity)
            starts.append(list(cuts))
            lengths.append([min(capacity, len(ids) - a) for a in cuts])
            checks.append([zlib.crc32(ids[a : a + capacity].tobytes()) for a in cuts])
        return starts, lengths, checks

    found = annotate(df, text, keep, "_start array<long>, _length array<long>, _check array<long>", work)
    parts = F.arrays_zip("_start", "_length", "_check")
    out = found.select(*[c for c in found.columns if c not in ("_start", "_length", "_check")], F.posexplode(parts))
    return out.select(
        *[c for c in out.columns if c not in ("pos", "col")],
        F.col("pos").alias("piece"),
        F.col("col._start").alias("start"),
        F.col("col._length").alias("length"),
        F.col("col._check").alias("ids_crc32"),
    )


class Capacities:
    """Segment tree over remaining capacities: which ones have open sequences."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.some = [False] * (2 * self.leaves)

    def put(self, capacity: int, some: bool) -> None:
        at = self.leaves + capacity
        self.some[at] = some
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def tightest(self, length: int) -> int:
        """Smallest open capacity of at least ``length``, or -1."""
        at = self.leaves + length
        while not self.some[at]:
            # Climb until there is a right neighbour, which holds the next capacities.
            while at & 1:
                at //= 2
                if at <= 1:
                    return -1
            at += 1
        while at < self.leaves:
            at = 2 * at if self.some[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Best-fit decreasing for ``counts`` pieces per length, as runs of pieces.

    Piece ``first + i`` of a length goes to sequence ``sequence + i`` at ``offset``.
    """
    tree = Capacities(capacity)
    open_runs: dict[int, deque[tuple[int, int]]] = {}
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def keep_open(room: int, start: int, size: int, ahead: bool = False) -> None:
        if room and size:
            runs = open_runs.setdefault(room, deque())
            runs.appendleft((start, size)) if ahead else runs.append((start, size))
            tree.put(room, True)

    for length in sorted(counts, reverse=True):
        first, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:
                room = capacity
                start, size = sequences, -(-left // (capacity // length))
                sequences += size
            else:
                start, size = open_runs[room].popleft()
                tree.put(room, bool(open_runs[room]))
            # A sequence takes pieces of this length until it has no room: it is then the tightest.
            each = room // length
            full = min(size, left // each)
            for k in range(each if full else 0):
                rows.append((length, first, full, start, capacity - room + k * length))
                first += full
            left -= each * full
            keep_open(room - each * length, start, full)
            start, size = start + full, size - full
            if size and left:  # fewer than one sequence takes
                rows += [(length, first + k, 1, start, capacity - room + k * length) for k in range(left)]
                keep_open(room - left * length, start, 1)
                start, size, left = start + 1, size - 1, 0
            keep_open(room, start, size, ahead=True)
    return pd.DataFrame(rows, columns=["length", "first", "size", "sequence", "offset"])


def assign(items: DataFrame, order: tuple[str, ...], capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``."""
    per_length = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(per_length.values())
    runs = plan(per_length, capacity).sort_values(["length", "first"])
    keys = (runs["length"].to_numpy(np.int64) << 48) + runs["first"].to_numpy(np.int64)
    first, sequence, offset = (runs[c].to_numpy(np.int64) for c in ("first", "sequence", "offset"))

    buckets = math.ceil(total / ROWS_PER_BUCKET) + 1
    spread = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    own = Window.partitionBy("length", "_bucket")
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = (
        spread.groupBy("length", "_bucket")
        .agg(F.count("*").alias("_n"))
        .select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    )
    numbered = spread.withColumn("_rank", F.row_number().over(own.orderBy(*order)) - 1)
    placed = numbered.join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = placed.select(*items.columns, F.col("_rank").cast("long").alias("_rank"))

    def place(chunks):
        import pyarrow as pa

        for chunk in chunks:
            length = chunk.column("length").to_numpy()
            rank = chunk.column("_rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            columns = [*chunk.columns[:-1], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*chunk.schema.names[:-1], "sequence_id", "offset"])

    schema = items.schema.add("sequence_id", "long").add("offset", "long")
    return batches(placed, place, schema)


def pack(
    df: DataFrame,
    tokenizer: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents with their place: ``pieces`` and sequence_id, offset."""
    items = durable(pieces(df, tokenizer, text, keep, capacity, end_id))
    return assign(items, (*keep, "piece", "ids_crc32"), capacity)
