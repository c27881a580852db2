"""Alignment of the tokens of two tokenizers by diagonal run skipping.

Both tokenizers read the same bytes, so their tokens are told apart by the byte offsets at
which they end. Where both end, a group is closed. Tokens that agree one to one lie on a
diagonal of the two arrays of ends: the current shift between the indices stays the same, and
steps of doubling width compare whole slices along it. At the first difference the step is
halved down to it; the group there is closed by walking the side that is behind, and the
shift is updated.

Texts are cut at single spaces between other signs, where neither tokenizer joins anything:
the first one splits before such a space, and no piece of the second has a space after
another sign. Each distinct part is encoded once while it is remembered; the memory is bounded
in bytes. A text that has no such space is one part.

A pair of tokens can end together only if the bytes of one end the bytes of the other. So the
pairs are known from the two vocabularies (a few hundred thousand), and the table of their
counts in the corpus is bounded whatever the corpus holds: it is counted per task, summed by
pair, and broadcast.

A null or empty text, and a text whose tokens do not give back its bytes, has no tokens. Rows
that repeat give the same result each and count each. Texts are read whole at any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from brightrow.llm.common import annotate, as_bytes, batches, groups, pick, ragged
from brightrow.llm.exchange import pack, unpack
from brightrow.session import durable, free

SPACE = "▁"  # how the second vocabulary writes a space
REMEMBERED_BYTES = 128 * 1024 * 1024
BATCH_BYTES = 1024 * 1024
FIRST_STEP = 4


def _byte_letters() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Vocabularies:
    """The two tokenizers, the bytes of their tokens, and the pairs that can end together."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = _byte_letters()
        named = self.first.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(named.values()) + 1)
        for token, i in named.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = []
        for i in range(self.second.get_piece_size()):
            piece = self.second.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.second.is_byte(i) else piece.replace(SPACE, " ").encode())
        self.sizes_a = np.array([len(b) for b in self.bytes_a], dtype=np.int64)
        self.sizes_b = np.array([len(b) for b in self.bytes_b], dtype=np.int64)
        # How a token is written: within its group or at its end, for A and for B.
        self.signs = [
            b"%d%s" % (i, sign)
            for tokens, signs in ((self.bytes_a, (b",", b"|")), (self.bytes_b, (b",", b";")))
            for sign in signs
            for i in range(len(tokens))
        ]
        self.pairs = self._pairs()

    def _pairs(self) -> np.ndarray:
        """Sorted keys of all pairs of which one's bytes end the other's."""
        by_a: dict[bytes, list[int]] = {}
        by_b: dict[bytes, list[int]] = {}
        for by, tokens in ((by_a, self.bytes_a), (by_b, self.bytes_b)):
            for i, token in enumerate(tokens):
                if token:
                    by.setdefault(token, []).append(i)
        found = set()
        for token, ids in by_a.items():
            for cut in range(len(token)):
                for b in by_b.get(token[cut:], ()):
                    found.update(self.key(a, b) for a in ids)
        for token, ids in by_b.items():
            for cut in range(len(token)):
                for a in by_a.get(token[cut:], ()):
                    found.update(self.key(a, b) for b in ids)
        return np.array(sorted(found), dtype=np.int64)

    def key(self, a, b):
        return a * len(self.bytes_b) + b

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a space and each part by the first, and of each part by the second, which adds the space."""
        a = [e.ids for e in self.first.encode_batch([" " + p for p in parts], add_special_tokens=False)]
        return a, self.second.encode(parts, num_threads=1)


@cache
def vocabularies(first: str, second: str) -> Vocabularies:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Vocabularies(first, second)


_CUT = re.compile(r"(?<=\S) (?=\S)")
_LOOSE = re.compile(r"\s ")


def parts_of(text: str) -> list[str]:
    """The text cut at single spaces between other signs."""
    if not text:
        return []
    if text[0].isspace() or text[-1].isspace() or _LOOSE.search(text) or re.search(r" \s", text):
        return _CUT.split(text)
    return text.split(" ")


class Column:
    """A growing array of numbers."""

    def __init__(self):
        self.size = 0
        self.data = np.empty(1024, dtype=np.int32)

    def extend(self, more: np.ndarray) -> None:
        need = self.size + len(more)
        if need > len(self.data):
            larger = np.empty(max(need, 2 * len(self.data)), dtype=np.int32)
            larger[: self.size] = self.data[: self.size]
            self.data = larger
        self.data[self.size : need] = more
        self.size = need


class Memory:
    """Tokens of the parts met so far, laid end to end; emptied when it holds too many bytes."""

    def __init__(self, first: str, second: str):
        self.vocabularies = vocabularies(first, second)
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.a, self.b = Column(), Column()
        # Where the tokens of each part begin and how many there are, whether they give back its bytes.
        self.begin_a, self.size_a, self.begin_b, self.size_b, self.good = Column(), Column(), Column(), Column(), Column()
        self.bytes = 0

    def learn(self, parts: list[str]) -> None:
        """Parts that meet at single spaces are encoded as one text, which is cut again where they end."""
        tight = [p for p in parts if not (p[0].isspace() or p[-1].isspace())]
        loose = [p for p in parts if p[0].isspace() or p[-1].isspace()]
        v = self.vocabularies
        if tight:
            text = " ".join(tight)
            (a,), (b,) = v.encode([text])
            whole = (" " + text).encode()
            if b"".join([v.bytes_a[i] for i in a]) == whole and b"".join([v.bytes_b[i] for i in b]) == whole:
                sizes = np.fromiter((len(p.encode()) + 1 for p in tight), dtype=np.int64, count=len(tight))
                self._add(tight, *self._shares(a, v.sizes_a, sizes), *self._shares(b, v.sizes_b, sizes), np.ones(len(tight)))
            else:
                # Some part does not come back from its tokens, which may shift the rest.
                loose = parts
        if loose:
            found = v.encode(loose)
            good = np.array([
                b"".join([v.bytes_a[i] for i in a]) == (" " + p).encode() == b"".join([v.bytes_b[i] for i in b])
                for p, a, b in zip(loose, *found)
            ])
            flat = [(np.array([i for f in side for i in f]), np.array([len(f) for f in side])) for side in found]
            self._add(loose, *flat[0], *flat[1], good)

    @staticmethod
    def _shares(ids: list[int], of_token: np.ndarray, of_part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and how many of them each part has; every part ends where a token ends."""
        ids = np.array(ids, dtype=np.int64)
        upto = np.searchsorted(np.cumsum(of_token[ids]), np.cumsum(of_part)) + 1
        return ids, np.diff(upto, prepend=0)

    def _add(self, parts, a: np.ndarray, sizes_a: np.ndarray, b: np.ndarray, sizes_b: np.ndarray, good: np.ndarray) -> None:
        for part in parts:
            self.known[part] = len(self.known)
        # The keys, their entries and the numbers beside them.
        self.bytes += 4 * sum(map(len, parts)) + 4 * (len(a) + len(b)) + 150 * len(parts)
        for flat, begin, size, ids, sizes in (
            (self.a, self.begin_a, self.size_a, a, sizes_a),
            (self.b, self.begin_b, self.size_b, b, sizes_b),
        ):
            begin.extend(flat.size + np.cumsum(sizes) - sizes)
            size.extend(sizes)
            flat.extend(ids)
        self.good.extend(good)

    def tokens(self, texts: list[str]):
        """Ids of both tokenizers over all texts, and per text their numbers and whether the bytes agree."""
        if self.bytes > REMEMBERED_BYTES:
            self._empty()
        split = [parts_of(t) for t in texts]
        flat = [p for parts in split for p in parts]
        at = list(map(self.known.get, flat))
        if None in at:
            self.learn(list(dict.fromkeys(p for p, i in zip(flat, at) if i is None)))
            at = list(map(self.known.get, flat))
        at = np.array(at, dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in split])
        bad = np.zeros(len(texts), dtype=bool)
        bad[owner[self.good.data[at] == 0]] = True
        use = ~bad[owner]
        at, owner = at[use], owner[use]
        out = []
        for ids, begin, size in ((self.a, self.begin_a, self.size_a), (self.b, self.begin_b, self.size_b)):
            sizes = size.data[at].astype(np.int64)
            out.append(ids.data[ragged(begin.data[at].astype(np.int64), sizes)])
            out.append(np.bincount(owner, weights=sizes, minlength=len(texts)).astype(np.int64))
        return out


@cache
def memory(first: str, second: str) -> Memory:
    return Memory(first, second)


def skip_runs(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Stretches where both end together token by token: their begin in A and in B, and length.

    Between two stretches lie tokens of one irregular group, which the first tokens of the
    next stretch close. Both lists are strictly ascending and their last entries are equal.
    """
    begins_a, begins_b, lengths = [], [], []
    i, j, n = 0, 0, len(ends_a)
    while i < n:
        begin, shift, step = i, j - i, FIRST_STEP
        # Along the diagonal: double the step while whole slices agree, then halve it down to the difference.
        while i + step <= n and ends_a[i : i + step] == ends_b[i + shift : i + step + shift]:
            i += step
            step *= 2
        while step > 1:
            step //= 2
            if i + step <= n and ends_a[i : i + step] == ends_b[i + shift : i + step + shift]:
                i += step
        j = i + shift
        if i > begin:
            begins_a.append(begin)
            begins_b.append(begin + shift)
            lengths.append(i - begin)
        if i == n:
            break
        # An irregular group: the side that is behind goes on until both end together.
        a, b = ends_a[i], ends_b[j]
        while a != b:
            if a < b:
                i += 1
                a = ends_a[i]
            else:
                j += 1
                b = ends_b[j]
    return begins_a, begins_b, lengths


def closed(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in A and in B of the tokens that close each group."""
    begins_a, begins_b, lengths = skip_runs(ends_a.tolist(), ends_b.tolist())
    sizes = np.array(lengths, dtype=np.int64)
    return ragged(np.array(begins_a, dtype=np.int64), sizes), ragged(np.array(begins_b, dtype=np.int64), sizes)


def in_groups(v: Vocabularies, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> np.ndarray:
    """Places in ``v.signs`` of all tokens, group after group: those of A, then those of B."""
    count = len(v.bytes_a), len(v.bytes_b)
    closes_a, closes_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    closes_a[last_a], closes_b[last_b] = 1, 1
    group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
    out = np.empty(len(a) + len(b), dtype=np.int64)
    # Before a token of A stand the tokens of B of earlier groups; before one of B those of A up to its own.
    out[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = a + count[0] * closes_a
    out[np.arange(len(b)) + last_a[group_b] + 1] = 2 * count[0] + b + count[1] * closes_b
    return out


def align(
    df: DataFrame, first: str, second: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), whole: bool = True
) -> DataFrame:
    """The ``keep`` columns with n_a, n_b, n_groups, groups_sha256, links and, if ``whole``, groups.

    ``first`` is a byte-level vocabulary (.json), which reads a space and the text; ``second``
    a vocabulary of pieces (.model), which reads the text and adds the space. ``links`` holds
    the numbers of the linked pairs, packed; see :func:`pair_counts`.
    """

    def work(texts: list[bytes | None]):
        v, known = vocabularies(first, second), memory(first, second)
        sign = v.signs.__getitem__
        rows = []
        bodies = [t or b"" for t in texts]
        for begin, end in groups(bodies, BATCH_BYTES):
            a, sizes_a, b, sizes_b = known.tokens([t.decode("utf-8", "replace") for t in bodies[begin:end]])
            last_a, last_b = closed(np.cumsum(v.sizes_a[a]), np.cumsum(v.sizes_b[b]))
            links = np.searchsorted(v.pairs, v.key(a[last_a].astype(np.int64), b[last_b].astype(np.int64)))
            written = in_groups(v, a, b, last_a, last_b).tolist()
            to_a, to_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
            to = np.searchsorted(last_a, to_a)
            since = at = 0
            for n_a, n_b, upto in zip(sizes_a.tolist(), sizes_b.tolist(), to.tolist()):
                if not n_a:
                    rows.append((0, 0, 0, "", None, ""))
                    continue
                # ``a1,a2|b1;a3|b2,b3``: the tokens of each group.
                listed = b"".join(map(sign, written[at : at + n_a + n_b]))[:-1]
                row = (n_a, n_b, upto - since, hashlib.sha256(listed).hexdigest(), pack(links[since:upto], "<u4"))
                rows.append((*row, listed.decode("ascii") if whole else None))
                since, at = upto, at + n_a + n_b
        columns = [list(c) for c in zip(*rows)] or [[]] * 6
        return columns if whole else columns[:5]

    results = "n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
    return annotate(df, text, keep, results + (", groups string" if whole else ""), work)


def pair_counts(aligned: DataFrame, first: str, second: str) -> DataFrame:
    """Per number of a linked pair: ids ``a`` and ``b``, and how many links of the corpus hold it."""

    def count(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(first, second)
        total = np.zeros(len(v.pairs), dtype=np.int64)
        for chunk in chunks:
            found = [unpack(x, "<u4") for x in chunk.column(0).to_pylist() if x is not None]
            if found:
                total += np.bincount(np.concatenate(found), minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["pair", "n"])

    split = batches(aligned.select("links"), count, "pair long, n long")
    return split.groupBy("pair").agg(F.sum("n").alias("n"))


def judge_links(aligned: DataFrame, counts: DataFrame, first: str, second: str, keep: tuple[str, ...]) -> DataFrame:
    """The ``keep`` columns with n_links, n_best and count_sum.

    ``counts`` has at most as many rows as the vocabularies have pairs, whatever the corpus.
    """
    found = counts.toPandas()
    v = vocabularies(first, second)
    count = np.zeros(len(v.pairs), dtype=np.int64)
    count[found["pair"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    of_b = v.pairs % len(v.bytes_b)
    most = np.zeros(len(v.bytes_b), dtype=np.int64)
    np.maximum.at(most, of_b, count)
    table = aligned.sparkSession.sparkContext.broadcast((count, count == most[of_b]))
    schema = T.StructType(
        [*[aligned.schema[c] for c in keep], *T.StructType.fromDDL("n_links long, n_best long, count_sum long")]
    )

    def look_up(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = table.value
        for chunk in chunks:
            rows = []
            for x in as_bytes(chunk.column(chunk.num_columns - 1)):
                links = unpack(x, "<u4") if x is not None else np.zeros(0, dtype=np.uint32)
                rows.append((len(links), int(best[links].sum()), int(count[links].sum())))
            made = [pa.array(c, type=pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([*chunk.columns[:-1], *made], names=schema.names)

    return batches(aligned.select(*keep, "links"), look_up, schema)


def alignment_report(documents: DataFrame, first: str, second: str) -> DataFrame:
    """Per document: numbers of tokens, groups and links, what the corpus counts say of them, a digest."""
    aligned = durable(align(pick(documents, "doc_id", "text"), first, second, whole=False))
    counts = durable(pair_counts(aligned, first, second))
    found = judge_links(aligned, counts, first, second, ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256"))
    free(counts)
    return found
