"""Operator 6: marginal likelihood of a text over all its subword segmentations.

Pieces come from an existing vocabulary; its scores, which rank them, give the first
weights (a Zipf law over ranks), and one expectation step over the training words,
each weighted by its count, gives the weights used. The probability of a word sums
over every way to cut it into pieces by a forward recursion in log space; single
bytes are pieces too, so every text has a probability. Words never share pieces, so
a document's marginal is the product over its words and the end.

The recursion runs once for each distinct word of the corpus. Documents are dealt in
blocks of about 16 MB; a block asks for its own distinct words and gets their counts
and probabilities back, so nothing that grows with the corpus is broadcast.

Null and empty texts have the end token alone; a null id counts as an empty one;
repeated rows count as often as they occur (rows equal in id and text share a block); ties do not arise;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written
from tidemark.llm.textblock import Prefix, column_bytes, groups, mix, ragged, words

BLOCK, STEP = 16 << 20, 1 << 20
#: Words longer than this many bytes are handled one by one.
LONG = 48
#: Distinct words in a task of the recursion.
WORDS = 50_000
SMOOTH = 0.05
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Pieces:
    """Pieces as bytes, with a blank for the start of a word, the 256 single bytes first."""

    def __init__(self, model_path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        scores: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
                continue
            b = sp.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in b[1:]:  # others never lie within a word
                scores[b] = max(scores.get(b, -math.inf), sp.get_score(i))
        low = min(scores.values(), default=0.0)
        low = max(low, -1e6)
        self.bytes = [bytes([k]) for k in range(256)] + [b for b in scores if len(b) > 1]
        self.widest = max(map(len, self.bytes))
        rank = np.array([-max(scores.get(b, low), low) for b in self.bytes])
        weight = 1 / (rank + 10)
        self.first = np.log(weight / (weight.sum() * 1.02))  # the rest is the end's
        data = np.frombuffer(b"".join(self.bytes), np.uint8)
        size = np.array([len(b) for b in self.bytes])
        ends = np.cumsum(size)
        h = piece_hash(Prefix(data), ends - size, ends)
        order = np.argsort(h)
        self.hash, self.of = h[order], order
        self.index = {b: k for k, b in enumerate(self.bytes)}

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 for none."""
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.of[at], -1)


def piece_hash(prefix: Prefix, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix(prefix.of(s, e) + (e - s).astype(np.uint64))


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _edges(p: Pieces, prefix: Prefix, at: np.ndarray, n: int) -> dict[tuple[int, int], np.ndarray]:
    """Piece ids of every span (i, j) of words of n bytes that start at `at`."""
    return {(i, j): p.find(piece_hash(prefix, at + i, at + j)) for j in range(1, n + 1) for i in range(max(0, j - p.widest), j)}


def _long_word(p: Pieces, b: bytes, logp: np.ndarray, expect: np.ndarray | None, c: float) -> float:
    """One long word: forward over positions, and backward for its expected pieces."""
    n = len(b)
    spans = [[(i, p.index[b[i:j]]) for i in range(max(0, j - p.widest), j) if b[i:j] in p.index] for j in range(1, n + 1)]
    alpha = np.full(n + 1, -np.inf)
    alpha[0] = 0
    for j, found in enumerate(spans, 1):
        alpha[j] = np.logaddexp.reduce([alpha[i] + logp[k] for i, k in found])
    if expect is not None:
        beta = np.full(n + 1, -np.inf)
        beta[n] = 0
        for j in range(n, 0, -1):
            for i, k in spans[j - 1]:
                expect[k] += c * math.exp(min(0.0, alpha[i] + logp[k] + beta[j] - alpha[n]))
                beta[i] = np.logaddexp(beta[i], logp[k] + beta[j])
    return float(alpha[n])


def marginals(p: Pieces, data: np.ndarray, s: np.ndarray, e: np.ndarray, logp: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each word data[s:e], expected count of each piece where counts are given)."""
    out, expect = np.zeros(len(s)), np.zeros(len(logp))
    sizes = e - s
    padded = np.append(logp, -np.inf)
    prefix = Prefix(data)
    for n in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == n)
        if n > LONG:
            for k in which.tolist():
                out[k] = _long_word(p, data[s[k] : e[k]].tobytes(), logp, expect if counts is not None and counts[k] else None, float(counts[k]) if counts is not None else 0)
            continue
        for part in np.array_split(which, max(1, len(which) * n * n // 4_000_000)):
            edges = _edges(p, prefix, s[part], n)
            alpha = [np.zeros(len(part))]
            for j in range(1, n + 1):
                a = np.full(len(part), -np.inf)
                for i in range(max(0, j - p.widest), j):
                    if (edges[i, j] >= 0).any():
                        a = np.logaddexp(a, alpha[i] + padded[edges[i, j]])
                alpha.append(a)
            out[part] = alpha[n]
            if counts is None or not counts[part].any():
                continue
            beta = [np.full(len(part), -np.inf) for _ in range(n)] + [np.zeros(len(part))]
            for j in range(n, 0, -1):
                for i in range(max(0, j - p.widest), j):
                    k = edges[i, j]
                    if not (k >= 0).any():
                        continue
                    own = padded[k] + beta[j]
                    beta[i] = np.logaddexp(beta[i], own)
                    with np.errstate(invalid="ignore"):
                        share = np.where(k >= 0, np.exp(np.minimum(alpha[i] + own - alpha[n], 0)), 0.0)
                    expect += np.bincount(k[k >= 0], (share * counts[part])[k >= 0], len(logp))
    return out, expect


def _block_words(data: np.ndarray, offsets: np.ndarray):
    """(lower-cased data, starts, ends, hash, first word of each document) of a block, step by step."""
    data = _LOWER[data]
    starts, ends, hashes, first = [], [], [], [np.zeros(1, np.int64)]
    n = 0
    for i, j in groups(offsets, STEP):
        d, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, f = words(d, bounds)
        hashes.append(piece_hash(Prefix(d), s, e))
        starts.append(s + offsets[i])
        ends.append(e + offsets[i])
        first.append(f[1:] + n)
        n += len(s)
    whole = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return data, whole(starts, np.int64), whole(ends, np.int64), whole(hashes, np.uint64), np.concatenate(first)


def _ask(table: pa.Table) -> pa.Table:
    """Distinct words of a block with their counts in training documents."""
    block, train = table["block"][0].as_py(), table["train"].to_numpy()
    data, s, e, h, first = _block_words(*column_bytes(table["text"]))
    code, kinds = pd.factorize(h)
    rep = np.zeros(len(kinds), np.int64)
    rep[code[::-1]] = np.arange(len(code))[::-1]
    c = np.bincount(code, np.repeat(train, np.diff(first)), len(kinds)).astype(np.int64)
    size = (e - s)[rep]
    text = data[ragged(s[rep], size)]
    word = pa.Array.from_buffers(pa.large_binary(), len(rep), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int64)), pa.py_buffer(text)]).cast(pa.binary())
    return pa.table({"block": pa.array(np.full(len(rep), block, np.int64)), "word": word, "c": pa.array(c)})


def _answer(docs: pa.Table, values: pa.Table, total: int, distinct: int, ends: int, log_end: float) -> pa.Table:
    """Scores of the documents of a block from the values of its words."""
    base = lambda c: np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    _, s, e, h, first = _block_words(*column_bytes(docs["text"]))
    if values.num_rows and len(s):
        data, off = column_bytes(values["word"].cast(pa.large_binary()).combine_chunks())
        known = np.concatenate([piece_hash(Prefix(data[off[i] : off[j]]), off[i:j] - off[i], off[i + 1 : j + 1] - off[i]) for i, j in groups(off, STEP)])
        order = np.argsort(known)
        at = order[np.searchsorted(known[order], h)]
        c, lp = values["c"].to_numpy()[at], values["logp"].to_numpy()[at]
    else:
        c, lp = np.zeros(len(s), np.int64), np.zeros(len(s))

    def per_doc(x):
        run = np.r_[0, np.cumsum(x)]
        return run[first[1:]] - run[first[:-1]]

    n = np.diff(first) + 1
    zero = np.zeros(len(s)) if not len(s) else None
    return pa.table({
        "doc_id": docs["doc_id"],
        "held_out": pa.array(docs["train"].to_numpy() == 0),
        "n_tokens": pa.array(n),
        "n_known": pa.array(per_doc(c > 0).astype(np.int64) + (1 if ends else 0)),
        "train_tokens": pa.array(np.full(len(n), total, np.int64)),
        "base_score": pa.array(per_doc(base(c) if zero is None else zero) + base(ends)),
        "score": pa.array((per_doc(lp) + log_end) / math.log(10)),
    })


def _learn(words_table: DataFrame, model_path: str) -> np.ndarray:
    """Expected count of each piece over the training words: at most a row for each piece and task reaches the shuffle."""

    def expect(batches):
        p, total = pieces(model_path), None
        for batch in batches:
            c = batch.column(1).to_numpy()
            data, s, e = _spelled(batch.column(0), c > 0)
            for i, j in groups(np.r_[0, e], STEP):
                base = s[i] if j > i else 0
                x = marginals(p, data[base : e[j - 1]], s[i:j] - base, e[i:j] - base, p.first, c[c > 0][i:j].astype(float))[1]
                total = x if total is None else total + x
        if total is not None:
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["piece", "n"])

    found = words_table.select("word", "c").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # a row for each piece of a fixed vocabulary
    out = np.zeros(len(pieces(model_path).bytes))
    out[found["piece"].to_numpy()] = found["n"].to_numpy()
    return out


def _spelled(column: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, each after a blank, as one run of bytes with starts and ends."""
    if keep is not None:
        column = column.filter(pa.array(keep))
    data, off = column_bytes(column)
    size = np.diff(off) + 1
    e = np.cumsum(size)
    out = np.full(int(size.sum()), 32, np.uint8)
    if len(data):
        out[ragged(e - size + 1, size - 1)] = data
    return out, e - size, e


def _valued(words_table: DataFrame, model_path: str, logp: np.ndarray) -> DataFrame:
    def run(batches):
        p = pieces(model_path)
        for batch in batches:
            data, s, e = _spelled(batch.column(0))
            parts = [np.empty(0)]
            for i, j in groups(np.r_[0, e], STEP):
                base = s[i]
                parts.append(marginals(p, data[base : e[j - 1]], s[i:j] - base, e[i:j] - base, logp)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(parts))], names=["word", "c", "logp"])

    return words_table.select("word", "c").mapInArrow(run, "word binary, c long, logp double")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10 == 0


def scores(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    n_bytes, ends = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)), F.count_if(~held_out(id_col))).first()
    blocks = max(1, -(-n_bytes // BLOCK))
    # By id and text, so that rows without an id and rows of one id spread.
    dealt = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).alias("block"), F.col(id_col).alias("doc_id"), (~held_out(id_col)).cast("int").alias("train"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    asked = written(dealt.groupBy("block").applyInArrow(_ask, "block long, word binary, c long"), "words")
    table = written(asked.groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    total, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    # Words, not bytes of files, make a task: the recursion is the work.
    table = table.repartition(max(1, -(-table.count() // WORDS)), "word")
    total, distinct = total + ends, distinct + (1 if ends else 0)
    n = _learn(table, model_path)
    mass = n.sum() + ends + SMOOTH * (len(n) + 1)
    logp, log_end = np.log((n + SMOOTH) / mass), math.log((ends + SMOOTH) / mass)
    values = asked.select("block", "word").join(_valued(table, model_path, logp), "word")
    id_type = docs.schema[id_col].dataType

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        return _answer(left, right, total, distinct, ends, log_end)

    schema = f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(answer, schema)
