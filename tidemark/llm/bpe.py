"""Operator 7: byte-level BPE over content-defined chunks that documents share.

Units are cut where the tokenizer's own pre-tokenisation always cuts: before a
single space or newline between two visible characters, and between a letter and
a point. A rolling hash of the 16
bytes before a unit decides where a chunk ends, so equal passages fall into equal
chunks wherever they stand. Within a block each distinct chunk, and each distinct
unit of those chunks, is encoded once; units that the worker encoded for earlier blocks, batches or tasks
are taken from a bounded map. Every distinct pair of units that meets at a
chunk join is encoded again as one string; where the ids differ, or where decoding
does not give back the document's bytes, the document is encoded whole.

Nulls and empty texts give no ids. Very long texts are one block of their own.
Repeated rows give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.textblock import Prefix, column_bytes, groups, mix, ragged

#: Bytes of text whose units are encoded together; chunks are shared within it, units by a worker.
BLOCK = 2 << 20
#: Bytes for which arrays of eight bytes a byte are held at once.
STEP = 1 << 20
_WINDOW, _MASK = 16, np.uint64(63)

_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x0A]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True  # two-byte characters from U+00C0 on: no white space among them
_NEXT = _VISIBLE | _LEAD
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_POINT = np.zeros(256, bool)
_POINT[list(b".,;:!?#*$%&")] = True  # none of them is in a special token


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, by rule: visible Latin-1 stands for itself."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """A byte-level BPE tokenizer file with exact bulk encoding of many units."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        stand = byte_alphabet()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = {int(x["id"]): x["content"] for x in json.load(open(path, encoding="utf-8"))["added_tokens"]}
        self.token = [b""] * size
        for text, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.token[i] = added[i].encode() if i in added else bytes(stand[c] for c in text)
        self.length = np.fromiter(map(len, self.token), np.int64, size)
        self.decimal = [b"%d" % i for i in range(size)]
        self.kept = Kept()

    def batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def kept_units(self, h: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray, joinable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `units`, for units with distinct hashes; those that this worker has met lately are not encoded again."""
        at = self.kept.find(h)
        old, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        ids, count = self.units(data, s[new], e[new], joinable[new])
        counts = np.empty(len(h), np.int64)
        counts[new], counts[old] = count, self.kept.count[at[old]]
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        out[ragged(begin[new], count)] = ids
        out[ragged(begin[old], counts[old])] = self.kept.ids[ragged(self.kept.start[at[old]], counts[old])]
        self.kept.add(h[new], ids, count)
        return out, counts

    def units(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, joinable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in turn, ids of each unit) for units data[s:e].

        Joinable units are strung together and encoded in long texts; token lengths
        show where each ends. A text whose tokens do not end where its units do is
        encoded unit by unit.
        """
        counts = np.zeros(len(s), np.int64)
        parts: list[np.ndarray] = [np.empty(0, np.int64)] * len(s) if not joinable.all() else []
        whole = np.flatnonzero(joinable)
        sizes = (e - s)[whole]
        flat = data[ragged(s[whole], sizes)].tobytes()
        ends = np.cumsum(sizes)
        cuts = [0]
        while len(whole) and cuts[-1] < len(whole):
            base = ends[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(ends, base + (1 << 16), "right"))))
        at = [int(ends[c - 1]) if c else 0 for c in cuts]
        runs: list[np.ndarray] = []
        for k in range(0, len(cuts) - 1, 16):
            texts = [flat[at[j] : at[j + 1]].decode("utf-8", "replace") for j in range(k, min(k + 16, len(cuts) - 1))]
            for j, ids in enumerate(self.batch(texts), k):
                ids = np.asarray(ids, np.int64)
                stops, tops = np.cumsum(self.length[ids]), ends[cuts[j] : cuts[j + 1]] - at[j]
                found = np.searchsorted(stops, tops)
                if len(stops) and found[-1] < len(stops) and (stops[np.minimum(found, len(stops) - 1)] == tops).all() and stops[-1] == tops[-1]:
                    counts[whole[cuts[j] : cuts[j + 1]]] = np.diff(found + 1, prepend=0)
                else:
                    own = self.batch([flat[a:b].decode("utf-8", "replace") for a, b in zip(np.r_[at[j], ends[cuts[j] : cuts[j + 1] - 1]], ends[cuts[j] : cuts[j + 1]], strict=True)])
                    counts[whole[cuts[j] : cuts[j + 1]]] = [len(x) for x in own]
                    ids = np.asarray([i for x in own for i in x], np.int64)
                runs.append(ids)
        joined = np.concatenate(runs) if runs else np.empty(0, np.int64)
        if not parts:
            return joined, counts
        alone = np.flatnonzero(~joinable)
        own = self.batch([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(s[alone], e[alone], strict=True)])
        counts[alone] = [len(x) for x in own]
        flags = np.repeat(joinable, counts)
        out = np.empty(int(counts.sum()), np.int64)
        out[flags] = joined
        out[~flags] = np.asarray([i for x in own for i in x], np.int64)
        return out, counts


class Kept:
    """Ids of units that a worker has encoded, by hash: at most LIMIT units, of which those used last stay."""

    LIMIT, LONGEST = 1 << 18, 64

    def __init__(self):
        self.hash, self.start, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.used, self.tick = np.empty(0, np.int32), np.empty(0, np.int64), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 for none."""
        self.tick += 1
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        at = np.where(self.hash[at] == h, at, -1)
        self.used[at[at >= 0]] = self.tick
        return at

    def add(self, h: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        short = count <= self.LONGEST
        if not short.any():
            return
        start = np.cumsum(count) - count + len(self.ids)
        self.hash = np.r_[self.hash, h[short]]
        self.start, self.count = np.r_[self.start, start[short]], np.r_[self.count, count[short]]
        self.used = np.r_[self.used, np.full(int(short.sum()), self.tick)]
        ids = np.r_[self.ids, ids.astype(np.int32)]
        keep = np.arange(len(self.hash))
        if len(keep) > self.LIMIT:
            keep = np.argsort(-self.used, kind="stable")[: self.LIMIT // 2]
        keep = keep[np.argsort(self.hash[keep])]
        self.hash, self.count, self.used = self.hash[keep], self.count[keep], self.used[keep]
        self.ids = ids[ragged(self.start[keep], self.count)]
        self.start = np.cumsum(self.count) - self.count


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


class Segments:
    """Units and chunks of a block of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, hashes, cut = [], [], [], []
        for i, j in groups(offsets, STEP):
            lo, hi = offsets[i], offsets[j]
            d, bounds = data[lo:hi], offsets[i : j + 1] - lo
            if not len(d):
                continue
            begin = np.zeros(len(d), bool)
            if len(d) > 2:
                at = np.flatnonzero(_CUT[d[1:-1]]) + 1
                left, right, before = d[at - 1], d[at + 1], d[np.maximum(at - 2, 0)]
                ok = _NEXT[right] & (_VISIBLE[left] | ((left >= 0x80) & (left < 0xC0) & _LEAD[before]))
                edge = np.zeros(len(d), bool)
                edge[np.maximum(bounds[1:] - 1, 0)] = True
                begin[at[ok & ~edge[at]]] = True
                at = np.flatnonzero(_POINT[d[1:]]) + 1
                begin[at[_LETTER[d[at - 1]]]] = True
            begin[bounds[:-1][bounds[:-1] < len(d)]] = True
            s = np.flatnonzero(begin)
            e = np.r_[s[1:], len(d)]
            prefix = Prefix(d)
            hashes.append(mix(prefix.of(s, e) ^ (e - s).astype(np.uint64)))
            roll = mix(prefix.of(np.maximum(s - _WINDOW, 0), s))
            cut.append((roll & _MASK) == 0)
            starts.append(s + lo)
            ends.append(e + lo)
        whole = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        self.data, self.offsets = data, offsets
        self.s, self.e = whole(starts, np.int64), whole(ends, np.int64)
        self.hash = whole(hashes, np.uint64)
        self.first = np.searchsorted(self.s, offsets)  # of each document's units
        opens = whole(cut, bool)
        opens[self.first[:-1][self.first[:-1] < len(self.s)]] = True
        self.chunk = np.flatnonzero(opens)  # first unit of each chunk
        self.chunk_end = np.r_[self.chunk[1:], len(self.s)].astype(np.int64) if len(self.chunk) else self.chunk
        self.doc_chunk = np.searchsorted(self.chunk, self.first)
        if len(self.s):
            spread = mix(self.hash + np.uint64(0x632BE59BD9B4E019))
            place = _place(np.arange(len(self.s)) - np.repeat(self.chunk, self.chunk_end - self.chunk))
            self.chunk_hash = mix(np.add.reduceat(spread * place, self.chunk))
        else:
            self.chunk_hash = self.hash

    def joinable(self, u: np.ndarray) -> np.ndarray:
        """Units that start with a separator and end with a visible character: strung together they still cut alike."""
        first, last, prior = self.data[self.s[u]], self.data[self.e[u] - 1], self.data[np.maximum(self.e[u] - 2, 0)]
        return _CUT[first] & (self.e[u] - self.s[u] > 1) & (_VISIBLE[last] | ((last >= 0x80) & (last < 0xC0) & _LEAD[prior] & (self.e[u] - self.s[u] > 2)))


def _place(k: np.ndarray) -> np.ndarray:
    """An odd weight for each place in a chunk."""
    return mix(k.astype(np.uint64) + np.uint64(0x9E37)) | np.uint64(1)


class Encoded:
    """Ids of the documents of a block, kept once for each distinct unit and chunk."""

    def __init__(self, enc: Encoder, data: np.ndarray, offsets: np.ndarray, repair: bool = True):
        seg = self.seg = Segments(data, offsets)
        self.enc = enc
        code, kept = pd.factorize(seg.chunk_hash)
        self.chunk_code = code
        own = np.zeros(len(kept), np.int64)
        own[code[::-1]] = np.arange(len(code))[::-1]  # first chunk of each kind
        self.own = own
        sizes = (seg.chunk_end - seg.chunk)[own]
        used = ragged(seg.chunk[own], sizes)  # units of the distinct chunks
        self.kind_end = np.cumsum(sizes)
        ucode, kinds = pd.factorize(seg.hash[used])
        rep = np.zeros(len(kinds), np.int64)
        rep[ucode[::-1]] = used[::-1]
        self.unit_code = ucode
        self.ids, self.count = enc.kept_units(kinds, data, seg.s[rep], seg.e[rep], seg.joinable(rep))
        self.at = np.cumsum(self.count) - self.count
        self.bad = np.zeros(len(offsets) - 1, bool)
        if repair and len(seg.chunk):
            self._joins(rep, used)

    def _joins(self, rep: np.ndarray, used: np.ndarray) -> None:
        """Encode the two units at each distinct join as one string; documents with a join that disagrees are marked."""
        seg = self.seg
        head = np.flatnonzero(~np.isin(seg.chunk, seg.first[:-1]))  # chunks that follow another of their document
        if not len(head):
            return
        kind_start = self.kind_end - (seg.chunk_end - seg.chunk)[self.own]
        right = self.unit_code[kind_start[self.chunk_code[head]]]
        left = self.unit_code[self.kind_end[self.chunk_code[head - 1]] - 1]
        code, pairs = pd.factorize(left.astype(np.int64) << 32 | right)
        a, b = rep[pairs >> 32], rep[pairs & 0xFFFFFFFF]
        la, lb = seg.e[a] - seg.s[a], seg.e[b] - seg.s[b]
        n = len(a)
        order = np.arange(2 * n) // 2 + n * (np.arange(2 * n) % 2)
        text = seg.data[ragged(np.r_[seg.s[a], seg.s[b]][order], np.r_[la, lb][order])]
        ends = np.cumsum(la + lb)
        ids, counts = self.enc.units(text, ends - la - lb, ends, seg.joinable(a) & seg.joinable(b))
        ka, kb = pairs >> 32, pairs & 0xFFFFFFFF
        agree = counts == self.count[ka] + self.count[kb]
        want = self.ids[ragged(np.r_[self.at[ka], self.at[kb]][order], np.r_[self.count[ka], self.count[kb]][order])]
        if len(want) == len(ids):
            same = np.add.reduceat(np.r_[want != ids, False].astype(np.int64), np.minimum(np.cumsum(counts) - counts, len(ids)))[: len(counts)] == 0
            agree &= same | (counts == 0)
        else:
            agree[:] = False
        if not agree.all():
            off = head[~agree[code]]
            self.bad[np.searchsorted(seg.doc_chunk, off, "right") - 1] = True

    def codes(self, i: int) -> np.ndarray:
        """Unit kinds of document i in turn."""
        c = self.chunk_code[self.seg.doc_chunk[i] : self.seg.doc_chunk[i + 1]]
        n = (self.seg.chunk_end - self.seg.chunk)[self.own][c]
        return self.unit_code[ragged(self.kind_end[c] - n, n)]

    def whole(self, i: int) -> list[int]:
        lo, hi = self.seg.offsets[i], self.seg.offsets[i + 1]
        return self.enc.batch([self.seg.data[lo:hi].tobytes().decode("utf-8", "replace")])[0]


def digests(enc: Encoder, data: np.ndarray, offsets: np.ndarray):
    """(number of ids, SHA-256 of the decimal ids, SHA-256 of the decoded text) of each document of a block."""
    x = Encoded(enc, data, offsets)
    ids, stop = x.ids.tolist(), np.cumsum(x.count).tolist()
    said, back, a = [], [], 0
    for b in stop:
        one = ids[a:b]
        said.append(b",".join([enc.decimal[i] for i in one]))
        back.append(b"".join([enc.token[i] for i in one]))
        a = b
    kinds = x.unit_code.tolist()
    chunk_said, chunk_back, chunk_n, a = [], [], [], 0
    for b in x.kind_end.tolist():
        chunk_said.append(b",".join([said[k] for k in kinds[a:b]]))
        chunk_back.append(b"".join([back[k] for k in kinds[a:b]]))
        a = b
    if len(kinds):
        per = x.count[x.unit_code]
        size = np.diff(x.kind_end, prepend=0)
        chunk_n = np.add.reduceat(per, x.kind_end - size).tolist()
    chunks, doc = x.chunk_code.tolist(), x.seg.doc_chunk.tolist()
    for i in range(len(offsets) - 1):
        mine = chunks[doc[i] : doc[i + 1]]
        text = data[offsets[i] : offsets[i + 1]].tobytes()
        decoded = b"".join([chunk_back[c] for c in mine])
        n, listed = sum([chunk_n[c] for c in mine]), b",".join([chunk_said[c] for c in mine])
        if x.bad[i] or decoded != text:  # a join that does not agree: encode the document whole
            own = x.whole(i)
            n, listed = len(own), b",".join([enc.decimal[k] for k in own])
            decoded = b"".join([enc.token[k] for k in own]).decode("utf-8", "replace").encode()
        yield n, hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()


def id_streams(enc: Encoder, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents of a block in turn, number of ids of each)."""
    x = Encoded(enc, data, offsets)
    c = x.chunk_code
    size = (x.seg.chunk_end - x.seg.chunk)[x.own][c]
    k = x.unit_code[ragged(x.kind_end[c] - size, size)]
    ids = x.ids[ragged(x.at[k], x.count[k])]
    run = np.r_[0, np.cumsum(x.count[k])]
    ends = run[x.seg.first]
    length = np.r_[0, np.cumsum(enc.length[ids])]
    again = np.flatnonzero(x.bad | (length[ends[1:]] - length[ends[:-1]] != np.diff(offsets)))
    counts = np.diff(ends)
    if len(again):  # documents with a join that does not agree are encoded whole
        parts = np.split(ids, ends[1:-1])
        for i in again:
            parts[i] = np.asarray(x.whole(i), np.int64)
        ids, counts = np.concatenate(parts), np.array([len(q) for q in parts])
    return ids, counts


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every document: a map without a shuffle."""

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in groups(offsets, BLOCK):
                found = list(digests(enc, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                n, ids, text = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
