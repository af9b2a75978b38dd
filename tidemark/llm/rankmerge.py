"""Operator 13: byte-level BPE by ranks, merged in padded matrices of pieces of like length.

A text is cut into pieces by a pattern; a piece that is a token as it stands is
that token, the others are merged. Pieces of a block that the worker has not met
lately are dealt by length into matrices, a row for each piece, a column for each
part, -1 behind the last. Each round every row merges its leftmost pair of least
rank: pairs are looked up in a hash table of (left id, right id), the merged part
is taken out of its row, so that the matrix gets narrower by a column, and rows
without a pair leave it. Every part is a token, so its rank is its id.

A piece of more than LONG bytes, of which a row would need as many rounds, takes its
pairs from a heap in the same order (rank, then place).

Nulls and empty texts give no ids. A text is held with its pieces by one task, about
15 times its size; bytes that are not UTF-8 are read as U+FFFD. Repeated rows give
repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from tidemark.llm.textblock import column_bytes, groups, ragged

#: Bytes of text whose pieces are encoded together.
BLOCK = 2 << 20
#: Bytes of the longest piece that is a row of a matrix, and cells of a matrix.
LONG, CELLS = 256, 1 << 20
#: Pieces that a worker keeps, and the characters of the longest that it keeps.
KEPT, KEPT_CHARS = 1 << 18, 64

_NONE = np.int64(1) << np.int64(40)  # the rank of no pair
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Pairs:
    """A hash table of pairs of ids with open addressing, searched for many pairs at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(4 * len(rank) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, live = self._slot(keys), np.arange(len(keys))
        while len(live):
            free = live[self.key[slot[live]] < 0]
            self.key[slot[free]] = keys[free]  # of those that meet in a slot one stays
            held = self.key[slot[live]] == keys[live]
            self.rank[slot[live[held]]] = rank[live[held]]
            live = live[~held]
            slot[live] = (slot[live] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where there is none or where a part is -1."""
        keys = left << 32 | right
        out = np.full(len(keys), _NONE, np.int64)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(keys[live])
        while len(live):
            held = self.key[slot]
            hit = held == keys[live]
            out[live[hit]] = self.rank[slot[hit]]
            on = ~hit & (held >= 0)
            live, slot = live[on], (slot[on] + 1) & self.mask
        return out


def _without(matrix: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Each row without its cell at `column`."""
    keep = np.arange(matrix.shape[1]) != column[:, None]
    return matrix[keep].reshape(len(matrix), matrix.shape[1] - 1)


class Ranks:
    """A rank file (base64 token, rank) and a pattern."""

    def __init__(self, path: str, pattern: str):
        lines = [x.split() for x in open(path, "rb") if x.strip()]
        self.id = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.token = {rank: token for token, rank in self.id.items()}
        self.single = np.array([self.id[bytes([b])] for b in range(256)], np.int64)
        found = [(self.id[t[:k]], self.id[t[k:]], rank) for t, rank in self.id.items() for k in range(1, len(t)) if t[:k] in self.id and t[k:] in self.id]
        self.pairs = Pairs(*np.array(found, np.int64).reshape(-1, 3).T)
        top = max(self.token) + 1
        self.length = np.array([len(self.token.get(i, b"")) for i in range(top)], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(self.token.get(i, b"") for i in range(top)), np.uint8)
        self.pattern = pattern
        self.kept: dict[str, bytes] = {}

    @cached_property
    def cut(self) -> Cut:
        """Made when a text is cut: decoding needs none."""
        return Cut(self.pattern)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        pieces = [self.cut(t) for t in texts]
        new = list(set().union(*pieces) - self.kept.keys())
        self.kept |= zip(new, self.merged([p.encode() for p in new]), strict=True)
        out = [b"".join(map(self.kept.__getitem__, p)) for p in pieces]
        for p in new:
            if len(p) > KEPT_CHARS:
                del self.kept[p]
        if len(self.kept) > KEPT:
            for p in list(self.kept)[: len(self.kept) - KEPT // 2]:
                del self.kept[p]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ragged(self.start[ids], self.length[ids])].tobytes()

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece; of pieces that are no token, those of like length share a matrix."""
        out = [b""] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            if p in self.id:
                out[i] = self.id[p].to_bytes(4, "little")
            elif len(p) > LONG:
                out[i] = np.array(self.by_heap(p), "<u4").tobytes()
            else:
                rest.append(i)
        rest.sort(key=lambda i: len(pieces[i]))
        size = np.array([len(pieces[i]) for i in rest], np.int64)
        a = 0
        while a < len(rest):
            widest = max(int(size[a]) + 1, int(size[a]) * 5 // 4)
            b = min(int(np.searchsorted(size, widest, "right")), a + max(1, CELLS // widest))
            for k, ids in self._rows([pieces[i] for i in rest[a:b]]):
                out[rest[a + k]] = ids
            a = b
        return out

    def _rows(self, pieces: list[bytes]):
        """(place, ids) of every piece of a matrix, in the order in which its rows end."""
        size = np.array([len(p) for p in pieces], np.int64)
        part = np.full((len(pieces), int(size.max())), -1, np.int64)
        part[np.arange(part.shape[1]) < size[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pairs.find(part[:, :-1].ravel(), part[:, 1:].ravel()).reshape(len(pieces), part.shape[1] - 1)
        place = np.arange(len(pieces))
        while len(place):
            width = part.shape[1]
            if width > 1:
                at = rank.argmin(1)
                least = rank[np.arange(len(place)), at]
            else:
                least = np.full(len(place), _NONE)
            ended = least == _NONE
            if ended.any():
                rows = part[ended].astype("<u4")
                raw, counts = rows.tobytes(), (part[ended] >= 0).sum(1).tolist()
                for r, (k, n) in enumerate(zip(place[ended].tolist(), counts, strict=True)):
                    yield k, raw[4 * r * width : 4 * (r * width + n)]
                part, rank, place = part[~ended], rank[~ended], place[~ended]
                if not len(place):
                    return
                at, least = at[~ended], least[~ended]
            part[np.arange(len(place)), at] = least
            part = _without(part, at + 1)
            rank = _without(rank, np.minimum(at + 1, width - 2))
            for p in (at - 1, at):  # the pairs that the merged part is in
                row = np.flatnonzero((p >= 0) & (p < width - 2))
                rank[row, p[row]] = self.pairs.find(part[row, p[row]], part[row, p[row] + 1])

    def by_heap(self, piece: bytes) -> list[int]:
        """The ids of one piece: the same merges in the same order, the next one taken from a heap."""
        part = self.single[np.frombuffer(piece, np.uint8)]
        n = len(part)
        rank = self.pairs.find(part[:-1], part[1:])
        heap = [int(r) * n + i for i, r in enumerate(rank.tolist()) if r < _NONE]
        heapq.heapify(heap)
        own, after, before = part.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        now = rank.tolist() + [int(_NONE)]  # the rank of the pair that begins at each place
        table = self.id
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if now[i] != r:
                continue  # the pair is gone
            j = after[i]
            own[i], after[i], now[j] = r, after[j], int(_NONE)
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a < 0:
                    continue
                b = after[a]
                now[a] = table.get(self.token[own[a]] + self.token[own[b]], int(_NONE)) if b < n else int(_NONE)
                if now[a] < _NONE:
                    heapq.heappush(heap, now[a] * n + a)
        out, i = [], 0
        while i < n:
            out.append(own[i])
            i = after[i]
        return out


class Cut:
    """A pattern with the letters, digits and blanks of the tiktoken library that is installed.

    The library's tables may be of another Unicode version than those of `regex`. Texts with
    a character on which they differ are matched with a stand-in of the library's class.
    """

    CLASSES = {"\\p{L}": "a", "\\p{N}": "1", "\\s": "\n"}

    def __init__(self, pattern: str):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        odd: dict[str, str] = {}
        for kind, sign in self.CLASSES.items():
            library = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            theirs, ours = set(bytes(library.encode_ordinary(every)).decode()), set(regex.findall(kind, every))
            odd = dict.fromkeys(ours - theirs, ".") | odd | dict.fromkeys(theirs - ours, sign)
        self.odd, self.stand = odd.keys(), str.maketrans(odd)

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand))]


@lru_cache(maxsize=2)
def ranks(path: str, pattern: str) -> Ranks:
    """One per worker process."""
    return Ranks(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of every document, ids as little-endian unsigned 32-bit integers: a map without a shuffle."""

    def run(batches):
        enc = ranks(path, pattern)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in groups(offsets, BLOCK):
                ids = enc.encode([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[i:j], offsets[i + 1 : j + 1], strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids binary")


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of `encoded` with `decoded`, the bytes that the ids stand for; fails on an id that the ranks do not have."""

    names = rows.columns
    at = names.index("ids")

    def run(batches):
        enc = ranks(path, pattern)
        for batch in batches:
            data, offsets = column_bytes(batch.column(at))
            for i, j in groups(offsets, BLOCK):
                ids = np.frombuffer(data[offsets[i] : offsets[j]].tobytes(), "<u4").astype(np.int64)
                if len(ids) and (ids.max() >= len(enc.length) or not enc.length[ids].all()):
                    raise ValueError("an id has no token")
                text, ends = enc.decode(ids), np.r_[0, np.cumsum(enc.length[ids])][(offsets[i : j + 1] - offsets[i]) // 4].tolist()
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), pa.array([text[a:b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())], names=[*names, "decoded"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("decoded", BinaryType()))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    back = decoded(encoded(docs, path, pattern, id_col, text_col), path, pattern)
    return back.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
