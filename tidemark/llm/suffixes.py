"""Operator 1: remove repeated byte windows by a depth-limited radix sort of suffixes.

Only equality through `WINDOW` bytes matters, so suffixes are ordered by most
significant digit only that far, and a suffix leaves as soon as its digit is unique.
Suffixes travel in runs: of the windows of a document, those whose least hashed
64-byte gram (leftmost of equals) is the same form one node, and the gram's place
aligns equal windows. A pass gives each node two digits: the bytes that all its
windows share and the bytes that any of them covers. If the second occurs twice, all
its windows are repeated; if the first has no other form, there is no more to find;
else one node of each form is split and goes to the next pass, down to single windows, whose equal groups are exactly the
repeated windows. A pass is counting and joining on digits: no group is ever
gathered, and a hot digit is combined before the shuffle.

The same passes run over words in place of bytes (`passages`): a text is then its sequence of word hashes, whatever blanks
lie between, and a range of words is cut from its first word's first byte to its last word's last.

A node is known by two 64-bit hashes, of the shared and of the covered bytes. Texts lie compressed in a table bucketed by
row, so later passes move nodes, not texts. Matches never cross rows; overlaps
count; nulls and texts below a window are left alone; repeated rows are
separate; an empty table gives an empty result; extra columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from tidemark.llm.shared import place, written
from tidemark.llm.textblock import Prefix, column_bytes, groups, mix, signed, words

WINDOW, GRAM = 400, 64
STEP = 1 << 20
_BITS = 26  # of a place in a block; longer texts take more


@dataclass(frozen=True)
class Kind:
    """What is compared: windows of so many units (bytes, or words), the units in a gram, windows in a node at each pass."""

    window: int
    gram: int
    sizes: tuple[int, ...]
    words: bool = False

    @property
    def reach(self) -> int:
        return self.window - self.gram + 1

    def units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units of a block of bytes, and the bounds of its documents among them."""
        if not self.words:
            return data, bounds
        s, e, first = words(data, bounds)
        return mix(Prefix(data).of(s, e) + (e - s).astype(np.uint64)), first

    def in_bytes(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of units of one text as ranges of its bytes."""
        if not self.words or not len(s):
            return s, e
        starts, ends, _ = words(data, np.array([0, len(data)]))
        return starts[s], ends[np.minimum(e, len(ends)) - 1]


BYTES = Kind(WINDOW, GRAM, (WINDOW - GRAM + 1, 169, 43, 8, 1))


def passages(n: int) -> Kind:
    """Windows of n words, up to 600."""
    gram = max(1, n // 4)
    sizes = [n - gram + 1]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // 4))
    return Kind(n, gram, tuple(sizes), True)


def least(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash (leftmost of equals) in every run of `width`, by block-wise running minima."""
    m = len(h)
    bits = np.uint64(max(_BITS, m.bit_length()))
    key = (h >> bits << bits) | np.arange(m, dtype=np.uint64)
    grid = np.concatenate([key, np.full(-m % width, ~np.uint64(0))]).reshape(-1, width)
    front = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = m - width + 1
    return (np.minimum(back[:n], front[width - 1 : width - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def anchors(data: np.ndarray, bounds: np.ndarray, kind: Kind) -> np.ndarray:
    """Places of the least grams of all windows that lie within a document."""
    if len(data) < kind.window:
        return np.empty(0, np.int64)
    at = np.arange(len(data) - kind.gram + 1)
    p = least(mix(Prefix(data).of(at, at + kind.gram)), kind.reach)
    inside = np.zeros(len(data) + 1, np.int32)
    size = np.diff(bounds)
    full = size >= kind.window
    np.add.at(inside, bounds[:-1][full], 1)
    np.add.at(inside, (bounds[1:] - kind.window + 1)[full], -1)
    return np.unique(p[np.cumsum(inside[: len(p)]) > 0])


def last(a, level: int, kind: Kind, least=np.minimum):
    """The last window of a node that starts with window a; a node ends with its parent at the latest."""
    end, start, rest = a * 0 + kind.reach - 1, a * 0, a
    for size in kind.sizes[1 : level + 1]:
        start, rest = start + rest - rest % size, rest % size
        end = least(end, start + size - 1)
    return end


def digits(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: np.ndarray, a: np.ndarray, level: int, kind: Kind):
    """(keep, shared, covered) of nodes: windows that start a..last units before p, in documents lo..hi."""
    size, b, window = kind.sizes[level], last(a, level, kind), kind.window
    keep = np.maximum(a, p + window - hi) <= np.minimum(b, p - lo)
    p, a, b, lo, hi = p[keep], a[keep], b[keep], lo[keep], hi[keep]
    prefix = Prefix(data)
    s, e = np.maximum(p - b, lo), np.minimum(p - a + window, hi)
    block = mix((a * 512 + size).astype(np.uint64))
    shape = mix((((p - s) << 10) | (e - p)).astype(np.uint64) ^ block)
    return keep, mix(prefix.of(p - a, p - b + window) ^ block), mix(prefix.of(s, e) + shape)


def _rows(rid, p, a, shared, covered) -> pa.RecordBatch:
    cols = [pa.array(x.astype(np.int64)) for x in (rid, p * 512 + a)] + [pa.array(signed(x)) for x in (shared, covered)]
    return pa.RecordBatch.from_arrays(cols, names=["rid", "at", "shared", "covered"])


_NODE = "rid long, at long, shared long, covered long"  # at: 512 p + a


class Texts:
    """The rows of a table with compressed texts, bucketed by a row id in the shared folder.

    With `shortest`, `copies` (rid, first) names the rows of that many bytes or more whose whole text occurs twice (two hashes of 128 bits are taken as the texts), and of
    each such text only the first row is compared: copies cost no nodes.
    """

    def __init__(self, docs: DataFrame, text_col: str = "text", shortest: int | None = None):
        spark = self.spark = docs.sparkSession
        self.columns, self.text_col = docs.columns, text_col
        rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = docs.select(F.monotonically_increasing_id().alias("_rid"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(text_col).isNull().alias("_null"), (F.struct(*rest) if rest else F.lit(False)).alias("_rest"))

        def pack(batches):
            z = zstandard.ZstdCompressor(level=1)
            for batch in batches:
                data, off = column_bytes(batch.column(1))
                texts = [data[i:j].tobytes() for i, j in zip(off[:-1], off[1:], strict=True)]
                same = pa.array([None if shortest is None or len(x) < shortest else hashlib.blake2b(x, digest_size=16).digest() for x in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([z.compress(x) for x in texts], pa.binary()), same, *batch.columns[2:]], names=["_rid", "_z", "_same", "_null", "_rest"])

        schema = StructType([StructField("_rid", LongType()), StructField("_z", BinaryType()), StructField("_same", BinaryType()), StructField("_null", BooleanType()), df.schema["_rest"]])
        table = f"tidemark_{uuid.uuid4().hex}"
        packed = df.mapInArrow(pack, schema).repartition(self.n, "_rid")
        packed.write.format("parquet").option("path", place(spark, "texts")).bucketBy(self.n, "_rid").saveAsTable(table)
        self.table = spark.table(table)
        spark.sql(f"DROP TABLE {table}")  # only its name: the files stay in the shared folder, and the relation is read from there
        self.compared, self.copies = self.table.select("_rid", "_z"), None
        if shortest is not None:
            alike = self.table.where("_same is not null").select("_rid", "_same")
            twice = alike.groupBy("_same").agg(F.min("_rid").alias("_first"), F.count("*").alias("_k")).where("_k > 1")
            self.copies = written(alike.join(twice, "_same").select(F.col("_rid").alias("rid"), (F.col("_rid") == F.col("_first")).alias("first")), "copies")
            self.compared = self.compared.join(self.copies.where("not first").hint("shuffle_hash"), F.col("_rid") == F.col("rid"), "left_anti")

    def with_(self, found: DataFrame, how: str = "inner") -> DataFrame:
        """Rows beside what is known of them; `found` has one row for each `rid`, and only it is shuffled."""
        return self.table.join(found.hint("shuffle_hash"), F.col("_rid") == F.col("rid"), how)


def _open(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    z = zstandard.ZstdDecompressor()
    texts = [z.decompress(x.as_py()) for x in column]
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)


def _blocks(column: pa.Array, kind: Kind):
    """(i, j, units, bounds) of texts i..j-1 of a column of compressed texts, in blocks of at most STEP bytes."""
    data, off = _open(column)
    for i, j in groups(off, STEP):
        yield i, j, *kind.units(data[off[i] : off[j]], off[i : j + 1] - off[i])


def _first_nodes(texts: Texts, kind: Kind) -> DataFrame:
    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                rid = part.column(0).to_numpy()
                for i, j, d, bounds in _blocks(part.column(1), kind):
                    p = anchors(d, bounds, kind)
                    if not len(p):
                        continue
                    of = np.searchsorted(bounds, p, "right") - 1
                    a = np.zeros(len(p), np.int64)
                    keep, *found = digits(d, bounds[of], bounds[of + 1], p, a, 0, kind)
                    yield _rows(rid[i:j][of][keep], (p - bounds[of])[keep], a[keep], *found)

    return texts.compared.mapInArrow(run, _NODE)


def _split_nodes(texts: Texts, nodes: DataFrame, level: int, kind: Kind) -> DataFrame:
    """The next pass: each node in parts of kind.sizes[level] windows."""
    by_row = nodes.groupBy("rid").agg(F.collect_list("at").alias("nodes"))  # as many as a text is long
    parts = -(-kind.sizes[level - 1] // kind.sizes[level])

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                rid = part.column(0).to_numpy()
                packed = part.column(2)
                listed, at = packed.flatten().to_numpy(), np.r_[0, np.cumsum([len(x) for x in packed])]
                for i, j, d, bounds in _blocks(part.column(1), kind):
                    x = listed[at[i] : at[j]]
                    of = np.repeat(np.arange(i, j), np.diff(at[i : j + 1]))
                    a = (x % 512)[:, None] + np.arange(parts) * kind.sizes[level]
                    own = (a <= last(x % 512, level - 1, kind)[:, None]).ravel()
                    a, of = a.ravel()[own], np.repeat(of, parts)[own]
                    lo = bounds[of - i]
                    p = np.repeat(x // 512, parts)[own] + lo
                    keep, *found = digits(d, lo, bounds[of - i + 1], p, a, level, kind)
                    yield _rows(rid[of][keep], (p - lo)[keep], a[keep], *found)

    return texts.with_(by_row).select("_rid", "_z", "nodes").mapInArrow(run, _NODE)


def repeated(texts: Texts, kind: Kind = BYTES, early: bool = False) -> DataFrame:
    """(rid, s, e): ranges of units of the rows that are covered by repeated windows; e may pass the end of the text.

    With `early`, each pass writes its ranges, so that the shuffles of all passes need not lie on disk together, and the first its nodes, so that texts are opened once for them.
    """
    ranges, nodes = None, None
    for level, size in enumerate(kind.sizes):
        if level == 0:
            rows = _first_nodes(texts, kind)
            rows = written(rows, "first") if early else rows
            twice = rows.groupBy("shared").agg(F.count("*").alias("k")).where("k > 1").select("shared")
            rows = rows.join(twice, "shared")  # most digits are unique: their nodes end here
        else:
            rows = _split_nodes(texts, nodes, level, kind)
        rows = written(rows, "nodes")
        # One node stands for each form; a form that occurs twice is settled, but still meets the other forms with its shared bytes.
        forms = rows.groupBy("shared", "covered").agg(F.count("*").alias("k"), F.min("rid").alias("rid"), F.min_by("at", "rid").alias("at"))
        again = forms.where("k > 1").select("shared", "covered")
        at, off = F.shiftright("at", 9), F.col("at") % 512
        hit = rows.join(again, ["shared", "covered"]).select("rid", F.greatest(at - last(off, level, kind, F.least), F.lit(0)).alias("s"), (at - off + kind.window).alias("e"))
        hit = written(hit, "hits") if early else hit
        ranges = hit if ranges is None else ranges.unionByName(hit)
        if size > 1:
            open_ = forms.groupBy("shared").agg(F.count("*").alias("forms")).where("forms > 1").select("shared")
            nodes = forms.join(open_, "shared").select("rid", "at")
    return ranges


def _cover(n: int, listed: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in any range."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, listed, 1)
    np.add.at(delta, np.minimum(ends, n), -1)
    return np.cumsum(delta[:n]) > 0


def _by_row(texts: Texts, kinds: tuple[Kind, ...] = (BYTES,), early: bool = False) -> DataFrame:
    """Rows with the ranges s0, e0 by the first of `kinds`, s1, e1 by the next; all are null where a row has none."""
    ranges = None
    for k, kind in enumerate(kinds):
        found = repeated(texts, kind, early).withColumn("kind", F.lit(k))
        ranges = found if ranges is None else ranges.unionByName(found)
    own = [F.collect_list(F.when(F.col("kind") == k, F.col(c))).alias(f"{c}{k}") for k in range(len(kinds)) for c in "se"]
    return texts.with_(ranges.groupBy("rid").agg(*own), "left")  # as many as a text is long


def report(docs: DataFrame, id_col: str = "doc_id", passage: int = 51) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes) of every row.

    What is removed are the windows of bytes alone. `n_passage_bytes` counts the bytes that lie in runs of `passage` words found twice or more, blanks between them included: they may be shorter than a window.
    """
    kinds = (BYTES, passages(passage))
    texts = Texts(docs.select(id_col, "text"), shortest=min(WINDOW, 2 * passage - 1))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, copied, *found in zip(*(batch.column(k) for k in range(1, 7)), strict=True):
                raw = np.frombuffer(z.decompress(packed.as_py()), np.uint8)
                gone = []
                for own, s, e in zip(kinds, found[::2], found[1::2], strict=True):
                    if copied.is_valid:  # every window of it occurs in its copy
                        n = len(own.units(raw, np.array([0, len(raw)]))[0])
                        listed = np.array([0] * (n >= own.window)), np.array([n] * (n >= own.window))
                    else:
                        listed = (s.values.to_numpy(), e.values.to_numpy()) if s.is_valid else (np.empty(0, np.int64),) * 2
                    gone.append(_cover(len(raw), *own.in_bytes(raw, *(x.astype(np.int64) for x in listed))))
                spans = int(np.count_nonzero(np.diff(gone[0].astype(np.int8), prepend=0) == 1))
                out.append((len(raw), int(gone[0].sum()), spans, hashlib.sha256(raw[~gone[0]].tobytes()).hexdigest(), int(gone[1].sum())))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if n == "kept_sha256" else pa.int64()) for n, c in zip(names, cols, strict=True))], names=[id_col, *names])

    copied = texts.copies.select(F.col("rid").alias("_copy"), F.lit(True).alias("_copied")).hint("shuffle_hash")
    x = _by_row(texts, kinds, early=True).join(copied, F.col("_rid") == F.col("_copy"), "left")
    return x.select(F.col(f"_rest.`{id_col}`"), "_z", "_copied", "s0", "e0", "s1", "e1").mapInArrow(run, f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long")


def removed(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = (BYTES,)) -> DataFrame:
    """`docs` with what is repeated by any of `kinds` cut out of the text; a character that loses a byte goes whole. Nulls stay null."""
    texts = Texts(docs, text_col)

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for packed, null, *found in zip(*(batch.column(k) for k in range(2 + 2 * len(kinds))), strict=True):
                raw = z.decompress(packed.as_py())
                if found[0].is_valid:
                    x = np.frombuffer(raw, np.uint8)
                    gone = np.zeros(len(x), bool)
                    for kind, s, e in zip(kinds, found[::2], found[1::2], strict=True):
                        gone |= _cover(len(x), *kind.in_bytes(x, s.values.to_numpy(), e.values.to_numpy()))
                    head = np.flatnonzero((x & 0xC0) != 0x80)  # of each character
                    lost = np.logical_or.reduceat(gone, head)
                    raw = x[~np.repeat(lost, np.diff(np.r_[head, len(x)]))].tobytes()
                out.append(None if null.as_py() else raw.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(batch.num_columns - 1), pa.array(out, pa.string())], names=["_rest", "_text"])

    schema = StructType([texts.table.schema["_rest"], StructField("_text", StringType())])
    found = _by_row(texts, kinds).select("_z", "_null", *[f"{c}{k}" for k in range(len(kinds)) for c in "se"], "_rest").mapInArrow(run, schema)
    return found.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_rest.`{c}`") for c in docs.columns])
