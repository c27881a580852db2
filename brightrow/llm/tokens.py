"""Token counts by merging many pre-tokens at once in ragged arrays.

A vocabulary of scored pieces is applied as its library does: start from characters,
merge the adjacent pair whose joined piece scores best (the leftmost of equals), until
none is left. No piece holds a space after another character, so a text splits before
every run of spaces into pre-tokens that merge apart from one another. Each distinct
pre-token is merged once: a batch of them lies in one flat array, and every round each
sequence applies its best pair. A character without a piece counts its UTF-8 bytes.

Where no tie and no better pair that the merge itself creates can interfere, a round
applies all places of a sequence's best pair, so long runs take few rounds. A pre-token
that is long by itself goes through the same rounds alone, on arrays of neighbours: its
places are kept by rank, and a round touches only those of the best pair and the pairs
that its merges make. So the work grows with the number of merges.

A null text counts as empty and has no bytes and no tokens. Rows that repeat give the
same result each. Texts are read whole at any length.
"""

from __future__ import annotations

import re
from functools import cache
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame

from brightrow.llm.common import annotate

SPACE = "▁"  # how the vocabulary writes a space
BATCH_CHARACTERS = 1_000_000
CACHED_BYTES = 64 * 1024 * 1024
LONG = 400  # characters from which a pre-token is merged alone, and not remembered
NONE = np.int64(1) << 62
GONE = -2


class Pieces:
    """Merge table of a scored vocabulary: symbols are numbers, a pair of them has a rank."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, normal = model.trainer_spec, model.normalizer_spec
        kinds = schema.ModelProto.SentencePiece
        ordinary = [p for p in model.pieces if p.type == kinds.NORMAL]
        extra = [p.piece for p in model.pieces if p.type not in (kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE)]
        if spec.model_type != 2 or extra or normal.name != "identity" or not spec.byte_fallback:
            raise ValueError("expects a BPE vocabulary with byte fallback, no normalisation and no user symbols")
        if normal.remove_extra_whitespaces or not normal.add_dummy_prefix or any(SPACE in p.piece.lstrip(SPACE) for p in ordinary):
            raise ValueError("expects a space put before the text, and pieces with spaces at their beginning only")
        scores = {p.piece: p.score for p in ordinary}
        order = sorted({-s for s in scores.values()})
        rank = {-s: i for i, s in enumerate(order)}
        characters = {c for piece in scores for c in piece}
        self.symbols = {s: i for i, s in enumerate(sorted(characters | set(scores)))}
        self.known = {c for c in characters if c in scores}
        self.count = len(self.symbols)
        merges = {}
        for piece, score in scores.items():
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    merges[left * self.count + right] = (rank[score], self.symbols[piece])
        self.keys = np.array(sorted(merges), dtype=np.int64)
        pairs = [merges[k] for k in self.keys.tolist()]
        self.ranks = np.array([p[0] for p in pairs], dtype=np.int64)
        self.made = np.array([p[1] for p in pairs], dtype=np.int64)
        self.merges = merges
        self.one_by_one = self._one_by_one(scores, rank)
        # What a character counts while it stays alone.
        self.alone = np.ones(self.count, dtype=np.int64)
        for c in set(self.symbols) - self.known:
            if len(c) == 1:
                self.alone[self.symbols[c]] = len(c.encode())

    def _one_by_one(self, scores, rank) -> np.ndarray:
        """Per rank: whether its merges must go one at a time.

        So it is if pieces share the rank, or if a piece joined with a neighbour makes
        one that ranks before the piece itself.
        """
        own = np.full(self.count, -1, dtype=np.int64)
        out = np.zeros(len(rank), dtype=bool)
        times = np.zeros(len(rank), dtype=np.int64)
        for piece, score in scores.items():
            own[self.symbols[piece]] = rank[score]
            times[rank[score]] += len(piece) > 1
        out[times > 1] = True
        for half in (self.keys // self.count, self.keys % self.count):
            early = own[half] >= self.ranks
            out[own[half][early]] = True
        return out

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.count + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each pre-token."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        total = np.zeros(len(words), dtype=np.int64)
        get = self.symbols.get
        flat = [get(c, -1) for w in words for c in w]
        symbol = np.array(flat, dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        alone = self.alone
        for i in np.flatnonzero(symbol < 0).tolist():
            word = owner[i]
            c = words[word][i - int(np.searchsorted(owner, word))]
            total[word] += len(c.encode("utf-8", "surrogatepass"))
        while True:
            same = owner[1:] == owner[:-1]
            rank, made = self.lookup(symbol[:-1], symbol[1:])
            rank[~same] = NONE
            possible = rank < NONE
            # Sequences without a pair are done.
            alive = np.zeros(len(words), dtype=bool)
            alive[owner[:-1][possible]] = True
            done = ~alive[owner]
            if done.any():
                finished = symbol[done]
                np.add.at(total, owner[done], np.where(finished >= 0, alone[finished], 0))
                keep = ~done
                # Pairs within living sequences stay pairs.
                inside = keep[:-1] & keep[1:] & same
                symbol, owner = symbol[keep], owner[keep]
                if not len(symbol):
                    return total
                still = np.zeros(len(symbol) - 1, dtype=bool)
                positions = np.cumsum(keep) - 1
                still[positions[:-1][inside]] = True
                moved_rank = np.full(len(symbol) - 1, NONE, dtype=np.int64)
                moved_made = np.zeros(len(symbol) - 1, dtype=np.int64)
                moved_rank[still], moved_made[still] = rank[inside], made[inside]
                rank, made = moved_rank, moved_made
            merge = self._chosen(owner, rank)
            symbol[:-1][merge] = made[merge]
            rest = np.ones(len(symbol), dtype=bool)
            rest[1:] = ~merge
            symbol, owner = symbol[rest], owner[rest]

    def count_long(self, word: str) -> int:
        """Number of tokens of one long pre-token."""
        symbol = np.array([self.symbols.get(c, -1) for c in word], dtype=np.int64)
        unknown = np.flatnonzero(symbol < 0).tolist()
        rest = Chain(self, symbol).merged()
        total = sum(len(word[i].encode("utf-8", "surrogatepass")) for i in unknown)
        return total + int(self.alone[rest[rest >= 0]].sum())

    def _chosen(self, owner: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Pairs to merge now: per sequence the best, all its places where that is safe."""
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        padded = np.append(rank, NONE)
        best = np.minimum.reduceat(padded, starts)
        sizes = np.diff(np.append(starts, len(owner)))
        mine = np.repeat(best, sizes)
        hit = (padded == mine) & (padded < NONE)
        places = np.flatnonzero(hit)
        first = np.ones(len(places), dtype=bool)
        first[1:] = owner[places][1:] != owner[places][:-1]
        # Of pairs that overlap, every second from the left of the run.
        chained = np.concatenate([[False], places[1:] == places[:-1] + 1]) & ~first
        run = np.flatnonzero(~chained)
        at = np.arange(len(places)) - np.repeat(run, np.diff(np.append(run, len(places))))
        alone = self.one_by_one[padded[places]]
        take = np.where(alone, first, at % 2 == 0)
        out = np.zeros(len(rank), dtype=bool)
        out[places[take]] = True
        return out


class Chain:
    """One long sequence of symbols with its neighbours, and the places of its pairs by rank."""

    def __init__(self, pieces: Pieces, symbol: np.ndarray):
        self.pieces, self.symbol, size = pieces, symbol, len(symbol)
        # The place after the last one holds no symbol; the place before the first one neither.
        self.symbol = np.append(symbol, [-1, -1])
        self.after = np.minimum(np.arange(1, size + 3), size)
        self.before = np.arange(-1, size + 1)
        self.places: dict[int, list] = {}
        self.ranks: list[int] = []
        self.size = size
        self._file(np.arange(size))

    def _file(self, left: np.ndarray) -> None:
        """Keep the pairs that begin at these places."""
        rank, _ = self.pieces.lookup(self.symbol[left], self.symbol[self.after[left]])
        left, rank = left[rank < NONE], rank[rank < NONE]
        if not len(left):
            return
        order = np.argsort(rank, kind="stable")
        left, rank = left[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, found in zip(rank[np.append(0, cuts)].tolist(), np.split(left, cuts)):
            kept = self.places.get(r)
            if kept is None:
                kept = self.places[r] = []
                heappush(self.ranks, r)
            if self.pieces.one_by_one[r]:
                for place in found.tolist():
                    heappush(kept, place)
            else:
                kept.append(found)

    def merged(self) -> np.ndarray:
        """The symbols that are left when no pair is."""
        while self.ranks:
            rank = self.ranks[0]
            if self.pieces.one_by_one[rank]:
                self._merge_first(rank)
            else:
                heappop(self.ranks)
                self._merge_all(rank, np.unique(np.concatenate(self.places.pop(rank))))
        out = self.symbol[: self.size]
        return out[out != GONE]

    def _merge_all(self, rank: int, left: np.ndarray) -> None:
        """Merge the pairs of this rank; of pairs that overlap every second from the left."""
        now, made = self.pieces.lookup(self.symbol[left], self.symbol[self.after[left]])
        left, made = left[now == rank], made[now == rank]
        if not len(left):
            return
        chained = np.append(False, self.after[left[:-1]] == left[1:])
        run = np.flatnonzero(~chained)
        at = np.arange(len(left)) - np.repeat(run, np.diff(np.append(run, len(left))))
        left, made = left[at % 2 == 0], made[at % 2 == 0]
        right = self.after[left]
        self.symbol[left], self.symbol[right] = made, GONE
        self.after[left] = self.after[right]
        self.before[self.after[left]] = left
        previous = self.before[left]
        self._file(np.unique(np.concatenate([previous[previous >= 0], left])))

    def _merge_first(self, rank: int) -> None:
        """Merge the leftmost pair of this rank."""
        kept = self.places[rank]
        if not kept:
            heappop(self.ranks)
            del self.places[rank]
            return
        left = heappop(kept)
        symbol, after = self.symbol, self.after
        right = after[left]
        found = self.pieces.merges.get(int(symbol[left]) * self.pieces.count + int(symbol[right])) if symbol[left] >= 0 <= symbol[right] else None
        if found is None or found[0] != rank:
            return
        symbol[left], symbol[right] = found[1], GONE
        following = after[left] = after[right]
        self.before[following] = left
        for place in (int(self.before[left]), left):
            if place >= 0:
                self._file_one(place)

    def _file_one(self, place: int) -> None:
        left, right = int(self.symbol[place]), int(self.symbol[self.after[place]])
        found = self.pieces.merges.get(left * self.pieces.count + right) if left >= 0 <= right else None
        if found is None:
            return
        kept = self.places.get(found[0])
        if kept is None:
            kept = self.places[found[0]] = []
            heappush(self.ranks, found[0])
        if self.pieces.one_by_one[found[0]]:
            heappush(kept, place)
        else:
            kept.append(np.array([place]))


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


_PARTS = re.compile(f"{SPACE}({SPACE}*[^{SPACE}]*)")


def pre_tokens(text: str) -> list[str]:
    """Runs of spaces with what follows up to the next space, each without its first space.

    The library puts a space before every text that is not empty.
    """
    if not text:
        return []
    if "  " not in text and text[0] != " " and SPACE not in text:
        return text.split(" ")
    return _PARTS.findall(SPACE + text.replace(" ", SPACE))


class Counter:
    def __init__(self, path: str):
        self.pieces = pieces(path)
        self.known: dict[str, int] = {}
        self.bytes = 0

    def count(self, texts: list[str]) -> list[int]:
        """Tokens per text; new pre-tokens of many texts are merged together."""
        out: list[int] = []
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            parts = pre_tokens(text)
            waiting.append(parts)
            size += len(text)
            if size > BATCH_CHARACTERS:
                out += self._settle(waiting)
                waiting, size = [], 0
        return out + self._settle(waiting)

    def _settle(self, waiting: list[list[str]]) -> list[int]:
        if self.bytes > CACHED_BYTES:
            self.known.clear()
            self.bytes = 0
        get = self.known.get
        found = [list(map(get, parts)) for parts in waiting]
        missing = {p for parts, got in zip(waiting, found) if None in got for p, n in zip(parts, got) if n is None}
        listed = [p for p in missing if len(p) < LONG]
        if listed:
            self.known.update(zip(listed, self.pieces.counts([SPACE + p for p in listed]).tolist()))
            # The keys, their entries and their counts.
            self.bytes += sum(map(len, listed)) + 150 * len(listed)
        alone = {p: self.pieces.count_long(SPACE + p) for p in missing if len(p) >= LONG}
        if alone:
            get = lambda p: alone[p] if p in alone else self.known[p]
        return [sum(map(get, parts)) if None in got else sum(got) for parts, got in zip(waiting, found)]


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(
    df: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 4096
) -> DataFrame:
    """The ``keep`` columns with n_bytes, n_tokens and whether they are over ``limit``."""

    def work(texts: list[bytes | None]):
        whole = [t or b"" for t in texts]
        found = counter(vocabulary).count([t.decode("utf-8", "replace") for t in whole])
        return [len(t) for t in whole], found, [n > limit for n in found]

    return annotate(df, text, keep, "n_bytes long, n_tokens long, over_limit boolean", work)
