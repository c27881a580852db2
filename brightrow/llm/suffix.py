"""Removal of repeated byte strings by interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier. Every
window of that length is known by its smallest hash over ``GRAM`` bytes, so equal windows
have equal keys wherever they stand. Neighbouring windows with one key are a segment
(at most ``WIDE`` windows), which its key brings to the same shard as all windows it could
equal.

1. Segments that are equal as a whole are one class, first within a block of documents,
   then in the shard: all but the first of a class go.
2. A class alone on its key has no equal window, unless it is periodic. What is left are
   periodic segments and the first segments of classes that share a key. The bytes of these go to the shard, which joins them into a
   text and builds its Burrows-Wheeler transform. Breadth-first backward extension of its
   intervals gives the common prefixes of neighbouring suffixes by increasing length, and
   stops at ``LENGTH``: what has no value by then is equal over a whole window.
3. A key with more than ``HOT`` classes is not joined: its windows are sent one by one,
   dealt out by their own 128-bit hash, and the first of each is found there.

Documents are ordered by id, then by a hash of the text; null ids come last. Rows equal
in id and text are one document and give the same result each. Null and empty texts have
no bytes. Ids are whole numbers. Texts are read whole at any length. An empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from brightrow.llm.common import as_bytes, batches, pick, ragged
from brightrow.llm.exchange import bucketed, pack, pack_sorted, shard_of, unpack, unpack_sorted
from brightrow.session import durable

LENGTH = 100
GRAM = 32
WIDE = LENGTH - GRAM + 1
BLOCK_BYTES = 2_500_000
PIECE_BYTES = 500_000
SHARD_BYTES = 12_000_000
JOINED_BYTES = 1_000_000
HOT = 256
MOST_SHARDS = 65_536
MOST_BUCKETS = 65_536  # Spark refuses more than 100,000
SEPARATOR = 0xFF  # never a byte of UTF-8
ODD = 0x9E3779B97F4A7C15
LAST = np.iinfo(np.int64).max


# Bounded Burrows-Wheeler expansion


def _sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotations in order of their first ``depth`` bytes or more, and the first 8 bytes of each."""
    n = len(text)
    around = np.resize(text, n + 8)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | around[i : i + n].astype(np.uint64)
    head, size = key, 8
    order = np.argsort(key)
    while True:
        line = key[order]
        new = np.concatenate([[True], line[1:] != line[:-1]])
        if size >= depth or new.all():
            return order, head[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64)
        key = (rank << np.uint64(32)) | np.roll(rank, -(size % n))
        order, size = np.argsort(key), 2 * size


def window_classes(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A number per place, equal where the next ``length`` bytes (around the end) are equal."""
    n = len(text)
    suffixes, head = _sorted_suffixes(text, length + 1)
    transform = text[suffixes - 1]
    back = np.empty(n, dtype=np.int64)  # row of a suffix -> row of the suffix one longer
    back[np.argsort(transform, kind="stable")] = np.arange(n)
    common = np.full(n + 1, -1, dtype=np.int16)
    common[0] = common[n] = 0
    # Prefixes shorter than the 8 bytes of the first key are read off the key.
    apart = head[1:] ^ head[:-1]
    for equal in range(7, -1, -1):
        common[1:n][(apart >> np.uint64(56 - 8 * equal)) != 0] = equal
    begin = np.flatnonzero(common[:n] >= 0)
    end = np.append(begin[1:], n) - 1
    chosen = common[end + 1] == 7
    low, high = begin[chosen], end[chosen]
    for level in range(8, length):
        if not len(low):
            break
        size = high - low + 1
        owner = np.repeat(np.arange(len(low)), size)
        rows = back[ragged(low, size)]
        order = np.argsort(rows)
        rows, owner = rows[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1] + 1) | (owner[1:] != owner[:-1])]))
        low, high = rows[starts], rows[np.append(starts[1:], len(rows)) - 1]
        fresh = common[high + 1] < 0
        low, high = low[fresh], high[fresh]
        common[high + 1] = level
    out = np.empty(n, dtype=np.int64)
    out[suffixes] = np.cumsum(common[:n] >= 0)
    return out


# Segments


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    size = 2 * PIECE_BYTES + 2 * LENGTH
    up = np.full(size + 1, ODD, dtype=np.uint64)
    down = np.full(size + 1, pow(ODD, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place: the hash of ``GRAM`` bytes, and the smallest in the window of ``LENGTH`` bytes from there."""
    n = len(data)
    up, down = _powers()
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])])
    key = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(29)
    least, size = key, 1
    while size < WIDE:
        step = min(size, WIDE - size)
        least, size = np.minimum(least[:-step], least[step:]), size + step
    return key, least


def _spread(key: np.ndarray) -> np.ndarray:
    """Smallest hashes are small numbers; one to one, these are even over all 64 bits."""
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return key ^ (key >> np.uint64(32))


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in lists of bounded size; pieces of a long text overlap by a window less one."""
    waiting, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), PIECE_BYTES):
            part = text[at : at + PIECE_BYTES + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if size + len(part) > PIECE_BYTES and waiting:
                yield waiting
                waiting, size = [], 0
            waiting.append((i, at, part))
            size += len(part)
    if waiting:
        yield waiting


def segments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """text, start, number of windows, key, hash of the whole bytes, and periodicity, per segment.

    A segment may hold one window twice only if its key's bytes stand in it twice.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for pieces in _pieces(texts):
        joined = b"".join(p for _, _, p in pieces)
        sizes = np.array([len(p) for _, _, p in pieces])
        windows = sizes - LENGTH + 1
        place = ragged(np.cumsum(sizes) - sizes, windows)
        piece = np.repeat(np.arange(len(pieces)), windows)
        grams, least = _keys(np.frombuffer(joined, dtype=np.uint8))
        key = least[place]
        begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])]))
        parts = -(-np.diff(np.append(begin, len(key))) // WIDE)
        begin = np.repeat(begin, parts) + WIDE * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        count = np.diff(np.append(begin, len(key)))
        at = place[begin]
        ends = at + count + LENGTH - 1
        whole = (xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(at.tolist(), ends.tolist()))
        own = piece[begin]
        first = np.array([i for i, _, _ in pieces]), np.array([o for _, o, _ in pieces])
        start = at - (np.cumsum(sizes) - sizes)[own] + first[1][own]
        reach = count + WIDE - 1
        same = grams[ragged(at, reach)] == np.repeat(key[begin], reach)
        periodic = np.add.reduceat(same, np.cumsum(reach) - reach, dtype=np.int64) > 1
        wholes = np.fromiter(whole, dtype=np.uint64, count=len(at))
        found.append((first[0][own], start, count, _spread(key[begin]), wholes, periodic))
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty.astype(bool)
    return tuple(np.concatenate(c) for c in zip(*found))


# Blocks: documents with their segments, and the classes of the block


_PACKED = ("sizes", "bytes", "ranks", "docs", "starts", "windows", "place", "first", "keys", "wholes", "names", "hashes", "periodic")


def _blocks(df: DataFrame, text: str, by: str) -> DataFrame:
    ids = T.StructField("ids", T.ArrayType(df.schema[by].dataType))
    schema = T.StructType(
        [T.StructField("block", T.StringType()), ids, *[T.StructField(c, T.BinaryType()) for c in _PACKED]]
    )

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        texts: list[bytes] = []
        names: list[pa.Array] = []
        size = 0
        for chunk in chunks:
            column = chunk.column(chunk.schema.get_field_index(by))
            begin = 0
            for i, t in enumerate(as_bytes(chunk.column(chunk.schema.get_field_index(text)))):
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield _block(f"{part}-{number}", texts, pa.concat_arrays([*names, column.slice(begin, i + 1 - begin)]))
                    texts, names, size, number, begin = [], [], 0, number + 1, i + 1
            names.append(column.slice(begin))
        if texts:
            yield _block(f"{part}-{number}", texts, pa.concat_arrays(names))

    return batches(df.select(by, text), run, schema)


def _block(name: str, texts: list[bytes], ids: pa.Array) -> pa.RecordBatch:
    order = np.array([LAST if i is None else i for i in ids.to_pylist()], dtype=np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, texts), dtype=np.uint64, count=len(texts))
    rank = _ranks(order, hashes)
    doc, start, windows, key, whole, periodic = segments(texts)
    line = np.lexsort((start, rank[doc], whole, key))
    new = np.concatenate([[True], (key[line][1:] != key[line][:-1]) | (whole[line][1:] != whole[line][:-1])])[: len(line)]
    place = np.empty(len(line), dtype=np.int64)
    place[line] = np.cumsum(new) - 1
    first = line[new]
    packed = {
        "sizes": pack(np.array([len(t) for t in texts]), "<u8"),
        "bytes": pack(np.frombuffer(b"".join(texts), dtype=np.uint8), "u1"),
        "ranks": pack(rank, "<u4"),
        "docs": pack(doc, "<u4"),
        "starts": pack(start, "<u8"),
        "windows": pack(windows, "u1"),
        "place": pack(place, "<u4"),
        "first": pack(first, "<u4"),
        "keys": pack_sorted(key[first]),
        "wholes": pack(whole[first], "<u8"),
        "names": pack(order, "<i8"),
        "hashes": pack(hashes, "<u8"),
        "periodic": pack(periodic[first], "u1"),
    }
    listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], type=pa.int32()), ids)
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), listed, *[pa.array([packed[c]]) for c in _PACKED]], names=["block", "ids", *_PACKED]
    )


def _ranks(order: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Dense rank of (id, hash)."""
    line = np.lexsort((hashes, order))
    new = np.ones(len(line), dtype=bool)
    new[1:] = (order[line][1:] != order[line][:-1]) | (hashes[line][1:] != hashes[line][:-1])
    rank = np.empty(len(line), dtype=np.int64)
    rank[line] = np.cumsum(new) - 1
    return rank


class _Read:
    """Columns of a block's row, unpacked on demand."""

    KINDS = dict(zip(_PACKED, ("<u8", "u1", "<u4", "<u4", "<u8", "u1", "<u4", "<u4", None, "<u8", "<i8", "<u8", "u1")))

    def __init__(self, row: pa.Table):
        self.row = row
        self.name = row.column("block")[0].as_py()

    def __getitem__(self, column: str) -> np.ndarray:
        data, kind = self.row.column(column)[0].as_py(), self.KINDS[column]
        found = unpack(data, kind) if kind else unpack_sorted(data)
        return found.astype(np.int64) if kind in ("<u4",) or column in ("windows", "sizes", "starts") else found


# What a block sends: entries with two hashes and the place where each stands first


SENT = "shard int, block string, kind int, keys binary, others binary, docs binary, names binary, hashes binary, starts binary, bytes binary"


def _send(rows, name: str, kind: int, shards: int, key, other, doc, names, hashes, start, texts=None) -> None:
    """Add one row per shard; entries are sorted by ``key``. ``other``: second hash, or number of windows."""
    shard = shard_of(key, shards)
    used, first = np.unique(shard, return_index=True)
    cuts = [*first.tolist(), len(key)]
    for s, a, b in zip(used.tolist(), cuts[:-1], cuts[1:]):
        own, at = np.unique(doc[a:b], return_inverse=True)
        rows.append(
            {
                "shard": s,
                "block": name,
                "kind": kind,
                "keys": pack_sorted(key[a:b]),
                "others": pack(other[a:b], "<u8"),
                "docs": pack(at, "<u4"),
                "names": pack(names[own], "<i8"),
                "hashes": pack(hashes[own], "<u8"),
                "starts": pack(start[a:b], "<u8"),
                "bytes": None if texts is None else pack(np.frombuffer(b"".join(texts[a:b]), dtype=np.uint8), "u1"),
            }
        )


_SENT_KINDS = {"shard": pa.int32(), "block": pa.string(), "kind": pa.int32()} | {
    c: pa.binary() for c in ("keys", "others", "docs", "names", "hashes", "starts", "bytes")
}
_ANSWER_KINDS = {"shard": pa.int32(), "block": pa.string(), "kind": pa.int32(), "codes": pa.binary()}
ANSWER = "shard int, block string, kind int, codes binary"
CLASSES, JOINED, SINGLE = 0, 1, 2
ALONE, GONE, FIRST, CROWDED = 0, 1, 2, 3


def _table(rows: list[dict], kinds: dict) -> pa.Table:
    return pa.table({n: pa.array([r[n] for r in rows], type=t) for n, t in kinds.items()})


def _send_classes(shards: int):
    def run(chunks):
        for chunk in chunks:
            for i in range(chunk.num_rows):
                block, rows = _Read(pa.Table.from_batches([chunk.slice(i, 1)])), []
                first = block["first"]
                if len(first):
                    _send(
                        rows, block.name, CLASSES, shards, block["keys"], block["wholes"], block["docs"][first],
                        block["names"], block["hashes"], block["starts"][first],
                    )
                    yield from _table(rows, _SENT_KINDS).to_batches()

    return run


def _received(group: pa.Table) -> tuple[list[int], tuple[np.ndarray, ...]]:
    """Entries per row, and key, other, document rank and start of all entries."""
    rows = group.to_pylist()
    keys = [unpack_sorted(r["keys"]) for r in rows]
    names, hashes, docs, shift = [], [], [], 0
    for r in rows:
        names.append(unpack(r["names"], "<i8"))
        hashes.append(unpack(r["hashes"], "<u8"))
        docs.append(unpack(r["docs"], "<u4").astype(np.int64) + shift)
        shift += len(names[-1])
    rank = _ranks(np.concatenate(names), np.concatenate(hashes))[np.concatenate(docs)]
    other = np.concatenate([unpack(r["others"], "<u8") for r in rows])
    start = np.concatenate([unpack(r["starts"], "<u8") for r in rows]).astype(np.int64)
    return [len(k) for k in keys], (np.concatenate(keys), other, rank, start)


def _first_of(line: np.ndarray, new: np.ndarray, rank: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Per entry: whether it stands where the first of its group does; ``line`` sorts by group, then place."""
    lead = line[new][np.cumsum(new) - 1]
    out = np.empty(len(line), dtype=bool)
    out[line] = (rank[line] == rank[lead]) & (start[line] == start[lead])
    return out


def _settle(hot: int):
    """Codes of classes or single windows: which of them stand first, and who shares their key."""

    def run(group: pa.Table) -> pa.Table:
        counts, (key, other, rank, start) = _received(group)
        line = np.lexsort((start, rank, other, key))
        new_key = np.ones(len(line), dtype=bool)
        new_key[1:] = key[line][1:] != key[line][:-1]
        new = new_key.copy()
        new[1:] |= other[line][1:] != other[line][:-1]
        first = _first_of(line, new, rank, start)
        on_key = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))
        classes = np.empty(len(line), dtype=np.int64)
        classes[line] = on_key[np.cumsum(new_key) - 1]
        codes = np.where(~first, GONE, np.where(classes == 1, ALONE, np.where(classes <= hot, FIRST, CROWDED)))
        return _answer(group, counts, codes)

    return run


def _answer(group: pa.Table, counts: list[int], codes: np.ndarray) -> pa.Table:
    ends = np.cumsum(counts)
    rows = [
        {"shard": s, "block": b, "kind": k, "codes": pack(codes[e - n : e], "u1")}
        for s, b, k, e, n in zip(
            group.column("shard").to_pylist(), group.column("block").to_pylist(), group.column("kind").to_pylist(),
            ends.tolist(), counts,
        )
    ]
    return _table(rows, _ANSWER_KINDS)


def _codes(answers: pa.Table, kind: int) -> np.ndarray:
    rows = sorted((r["shard"], r["codes"]) for r in answers.to_pylist() if r["kind"] == kind)
    return np.concatenate([unpack(c, "u1") for _, c in rows] or [np.zeros(0, dtype=np.uint8)])


class _Left:
    """Classes of a block whose windows are still open: to be joined, or sent one by one."""

    def __init__(self, block: _Read, codes: np.ndarray):
        first = block["first"]
        sizes, starts, windows = block["sizes"], block["starts"], block["windows"]
        base = np.cumsum(sizes) - sizes
        self.data = block["bytes"].tobytes()
        self.joined = np.flatnonzero((codes == FIRST) | (codes == ALONE) & (block["periodic"] > 0))
        self.crowded = np.flatnonzero(codes == CROWDED)
        self.doc, self.start, self.windows = block["docs"][first], starts[first], windows[first]
        self.at = base[self.doc] + self.start

    def text(self, c: int) -> bytes:
        return self.data[self.at[c] : self.at[c] + self.windows[c] + LENGTH - 1]

    def singles(self) -> tuple[np.ndarray, ...]:
        """Sorted by hash: class, offset in it, and two hashes, of every crowded window."""
        own = np.repeat(self.crowded, self.windows[self.crowded])
        offset = ragged(np.zeros(len(self.crowded), dtype=np.int64), self.windows[self.crowded])
        spans = [(a, a + LENGTH) for a in (self.at[own] + offset).tolist()]
        hashes = [
            np.array([xxhash.xxh64_intdigest(self.data[a:b], seed) for a, b in spans], dtype=np.uint64) for seed in (1, 2)
        ]
        line = np.lexsort((hashes[1], hashes[0]))
        return own[line], offset[line], hashes[0][line], hashes[1][line]


def _send_left(shards: int):
    def run(key, row: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[dict] = []
        if row.num_rows and answers.num_rows:
            block = _Read(row)
            left = _Left(block, _codes(answers, CLASSES))
            keys, names, hashes = block["keys"], block["names"], block["hashes"]
            c = left.joined
            if len(c):
                texts = [left.text(i) for i in c.tolist()]
                _send(rows, block.name, JOINED, shards, keys[c], left.windows[c], left.doc[c], names, hashes, left.start[c], texts)
            if len(left.crowded):
                own, offset, h, g = left.singles()
                _send(rows, block.name, SINGLE, shards, h, g, left.doc[own], names, hashes, left.start[own] + offset)
        return _table(rows, _SENT_KINDS)

    return run


def _settle_left(group: pa.Table) -> pa.Table:
    """Per window, whether an equal one stands earlier."""
    if group.column("kind")[0].as_py() == SINGLE:
        return _settle(0)(group)
    counts, (key, windows, rank, start) = _received(group)
    windows = windows.astype(np.int64)
    data = np.concatenate([unpack(b, "u1") for b in group.column("bytes").to_pylist()])
    sizes = windows + LENGTH - 1
    at = np.cumsum(sizes) - sizes
    line = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[line][1:] != key[line][:-1]])
    begins = np.flatnonzero(new)
    per_key = np.add.reduceat(sizes[line] + 1, begins)
    gone = np.zeros(int(windows.sum()), dtype=np.uint8)
    out_at = np.cumsum(windows) - windows
    begin = 0
    while begin < len(begins):
        end = begin + max(1, int(np.searchsorted(np.cumsum(per_key[begin:]), JOINED_BYTES, side="right")))
        chosen = line[begins[begin] : begins[end] if end < len(begins) else len(line)]
        _joined(chosen, data, at, sizes, windows, rank, start, out_at, gone)
        begin = end
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(windows)])
    spans = [int(total[e] - total[e - n]) for e, n in zip(ends.tolist(), counts)]
    return _answer(group, spans, gone)


def _joined(chosen, data, at, sizes, windows, rank, start, out_at, gone) -> None:
    """Mark the windows of the ``chosen`` contexts that an equal window precedes."""
    framed = np.full(int((sizes[chosen] + 1).sum()), SEPARATOR, dtype=np.uint8)
    place = np.cumsum(sizes[chosen] + 1) - (sizes[chosen] + 1)
    framed[ragged(place, sizes[chosen])] = data[ragged(at[chosen], sizes[chosen])]
    classes = window_classes(framed)
    count = windows[chosen]
    own = np.repeat(chosen, count)
    offset = ragged(np.zeros(len(chosen), dtype=np.int64), count)
    group = classes[np.repeat(place, count) + offset]
    stands = start[own] + offset
    line = np.lexsort((stands, rank[own], group))
    new = np.concatenate([[True], group[line][1:] != group[line][:-1]])
    gone[out_at[own] + offset] = ~_first_of(line, new, rank[own], stands)


def _finish(by: str, schema: T.StructType):
    def run(key, row: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Read(row)
        sizes, docs, starts, windows, place = (block[c] for c in ("sizes", "docs", "starts", "windows", "place"))
        codes = _codes(answers, CLASSES)
        left = _Left(block, codes)
        ranks, first = block["ranks"], block["first"]
        base = np.cumsum(sizes) - sizes
        lead = first[place]
        is_first = (ranks[docs] == ranks[docs[lead]]) & (starts == starts[lead])
        change = np.zeros(len(left.data) + 1, dtype=np.int32)

        def remove(at: np.ndarray, size) -> None:
            np.add.at(change, at, 1)
            np.add.at(change, at + size, -1)

        whole = ~is_first | (codes[place] == GONE)
        remove(base[docs[whole]] + starts[whole], windows[whole] + LENGTH - 1)
        # Windows of the classes still open, for each place where such a class stands first.
        own = np.repeat(left.joined, left.windows[left.joined])
        offset = ragged(np.zeros(len(left.joined), dtype=np.int64), left.windows[left.joined])
        gone = _codes(answers, JOINED).astype(bool)
        if len(left.crowded):
            single, at, _, _ = left.singles()
            out = _codes(answers, SINGLE) == GONE
            own, offset, gone = np.append(own, single), np.append(offset, at), np.append(gone, out)
        own, offset = own[gone], offset[gone]
        line = np.argsort(own, kind="stable")
        own, offset = own[line], offset[line]
        stays = np.flatnonzero(is_first & ~whole)
        low = np.searchsorted(own, place[stays], side="left")
        many = np.searchsorted(own, place[stays], side="right") - low
        at = np.repeat(base[docs[stays]] + starts[stays], many) + offset[ragged(low, many)]
        remove(at, LENGTH)
        removed = np.cumsum(change)[:-1] > 0
        begins = removed.copy()
        begins[1:] &= ~removed[:-1]
        inner = base[sizes > 0]
        begins[inner] = removed[inner]
        total = np.concatenate([[0], np.cumsum(removed)])
        spans = np.concatenate([[0], np.cumsum(begins)])
        n_removed = total[base + sizes] - total[base]
        n_spans = spans[base + sizes] - spans[base]
        data = np.frombuffer(left.data, dtype=np.uint8)
        digests = []
        for a, n, r in zip(base.tolist(), sizes.tolist(), n_removed.tolist()):
            part = left.data[a : a + n] if not r else data[a : a + n][~removed[a : a + n]].tobytes()
            digests.append(hashlib.sha256(part).hexdigest())
        ids = row.column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(sizes), pa.array(n_removed), pa.array(n_spans), pa.array(digests)], names=schema.names)

    return run


def _buckets(size: int) -> int:
    """Buckets for text of ``size`` bytes: about one per block, several blocks share one beyond the bound."""
    return min(MOST_BUCKETS, max(4, math.ceil(size / BLOCK_BYTES)))


def remove_repeats(df: DataFrame, text: str = "text", by: str = "doc_id", hot: int = HOT) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay."""
    docs = pick(df, by, text)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = min(MOST_SHARDS, max(4, math.ceil(size / SHARD_BYTES)))
    blocks = bucketed(_blocks(docs, text, by), _buckets(size))
    needed = blocks.select("block", "docs", "starts", "first", "keys", "wholes", "names", "hashes", "periodic")
    sent = batches(needed, _send_classes(shards), SENT)
    # By number, so that small shuffled rows, which cost much work each, are not put together.
    classes = durable(sent.repartition(shards, "shard").groupBy("shard").applyInArrow(_settle(hot), ANSWER))
    open_ones = blocks.groupBy("block").cogroup(classes.groupBy("block")).applyInArrow(_send_left(shards), SENT)
    dealt = open_ones.repartition(shards, "kind", "shard").groupBy("kind", "shard")
    windows = durable(dealt.applyInArrow(_settle_left, ANSWER))
    schema = T.StructType(
        [docs.schema[by]]
        + T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields
    )
    answers = classes.unionByName(windows)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish(by, schema), schema)
