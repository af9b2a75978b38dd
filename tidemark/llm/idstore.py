"""Operator 2: token ids in a content-addressed store.

The id stream of each document is cut where a rolling hash over four ids says so.
A store is a folder of three Parquet tables:

* ``raw/kind=chunk``: digest (SHA-256 of the little-endian ids), n, body; each digest once;
* ``raw/kind=recipe``: as encoded, in no order;
* ``recipes``: row, doc_id, n_tokens, root, leaves, start, in ascending doc_id order (ties by root); row counts from 0.

``root`` is a Merkle root over a document's leaves; a reader recomputes it, and the
digest of every chunk, and fails on a difference. Nulls and empty texts hold the end
id alone, or nothing where there is none; a null doc_id comes first; repeated rows are separate documents that share
chunks; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.bpe import encoder, id_streams
from tidemark.llm.shared import place
from tidemark.llm.textblock import column_bytes, groups, mix

#: Bytes of text encoded at once: an encoder needs about 50 times as much, beside the digests a task has sent.
BLOCK = 5 << 20
#: Chunks have 512 ids on average and 4,096 at most.
_MASK, LONGEST = np.uint64(511), 4096
_MULT = np.uint64(0x2545F4914F6CDD1D)


def cuts(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of the chunks of id streams that stand in turn and end at `ends`; a cut depends on the four ids before it."""
    n = len(ids)
    counts = np.diff(ends, prepend=0)
    place = np.arange(n) - np.repeat(ends - counts, counts)
    x = ids.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for k in range(4):
        past = np.zeros(n, np.uint64)
        past[k:] = x[: n - k]
        h = h * _MULT + np.where(place >= k, past, np.uint64(0))
    at = np.unique(np.r_[np.flatnonzero((mix(h) & _MASK) == 0) + 1, ends])
    at = at[at > 0]
    gaps = np.diff(at, prepend=0)
    if (gaps > LONGEST).any():
        at = np.concatenate([np.r_[np.arange(a - g + LONGEST, a, LONGEST), a] for a, g in zip(at, gaps, strict=True)])
    return at


def merkle(leaves: list[bytes]) -> bytes:
    """Pairwise SHA-256 up to one root; an odd node moves up as it is, and leaves and nodes hash differently."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"\0").digest()]
    while len(level) > 1:
        up = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = up + level[-1:] * (len(level) % 2)
    return level[0]


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two reflected polynomials modulo the CRC-32 polynomial."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = (b >> 1) ^ _POLY if b & 1 else b >> 1
        bit >>= 1
    return out


@lru_cache(maxsize=1 << 16)
def _shift(n: int) -> int:
    """x to the power 8n: what n further bytes do to a CRC."""
    out, square = 1 << 31, 1 << 23
    while n:
        if n & 1:
            out = _times(out, square)
        square, n = _times(square, square), n >> 1
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from (crc, bytes) of its parts."""
    crc = 0
    for own, n in parts:
        crc = _times(_shift(n), crc) ^ own
    return crc


def _schema(docs: DataFrame, id_col: str) -> str:
    return f"kind string, digest binary, n int, body binary, doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, root binary, leaves array<binary>"


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode `docs` and write a store at `path`, a folder that all executors share."""
    spark, schema = docs.sparkSession, _schema(docs, id_col)

    def encode(batches):
        enc = encoder(tokenizer_path)
        kind = np.dtype("<u2") if len(enc.token) <= 1 << 16 else np.dtype("<u4")
        seen: set[bytes] = set()
        dealt = 0
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in groups(offsets, BLOCK):
                rows: list[tuple] = []
                keys = batch.column(0).slice(i, j - i).to_pylist()
                ids, counts = id_streams(enc, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = np.cumsum(counts)
                if end_id is not None:
                    ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
                raw, width, cut = ids.astype(kind).tobytes(), kind.itemsize, cuts(ids, ends)
                upto, cut, a, k = np.searchsorted(cut, ends, "right").tolist(), cut.tolist(), 0, 0
                for key, top in zip(keys, upto, strict=True):
                    leaves, begin = [], a
                    for b in cut[k:top]:
                        body = raw[a * width : b * width]
                        leaf = hashlib.sha256(body).digest()
                        leaves.append(leaf)
                        if leaf not in seen:
                            seen.add(leaf)
                            rows.append(("chunk", leaf, b - a, body, None, None, None, None))
                        a = b
                    k = top
                    root = merkle(leaves)
                    dealt += 1
                    rows.append(("recipe", hashlib.sha256(root + dealt.to_bytes(8, "little")).digest(), None, None, key, a - begin, root, leaves))
                    if len(rows) >= 4000:
                        yield _batch(rows, batch.column(0).type)
                        rows = []
                if rows:
                    yield _batch(rows, batch.column(0).type)

    def once(batches):
        seen: set[bytes] = set()
        for batch in batches:
            keep = []
            for kind, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(kind == "recipe" or digest not in seen)
                if kind == "chunk":
                    seen.add(digest)
            yield batch.filter(pa.array(keep))

    raw = docs.select(id_col, text_col).mapInArrow(encode, schema)
    # A task sends each digest once, so that no digest is hot; recipes are dealt by root and their place in the task, so that copies spread.
    raw = raw.repartition("digest").mapInArrow(once, schema)
    raw.write.partitionBy("kind").parquet(f"{path}/raw")
    _order(spark, path, schema)


def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.int32(), pa.binary(), key, pa.int64(), pa.binary(), pa.list_(pa.binary()))
    names = ("kind", "digest", "n", "body", "doc_id", "n_tokens", "root", "leaves")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _order(spark: SparkSession, path: str, schema: str) -> None:
    """Write the recipes in document order with the rows and ids before each: sums of partitions, then sums within them."""
    recipes = spark.read.schema(schema).parquet(f"{path}/raw").where("kind = 'recipe'").select("doc_id", "n_tokens", "root", "leaves")
    dealt = recipes.repartitionByRange(F.col("doc_id"), F.col("root")).withColumn("part", F.spark_partition_id())
    dealt.sortWithinPartitions("doc_id", "root").write.parquet(f"{path}/dealt")
    dealt = spark.read.parquet(f"{path}/dealt")
    sums = dealt.groupBy("part").agg(F.sum("n_tokens").alias("s"), F.count("*").alias("n"))  # a row for each partition
    past = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("part", F.sum("s").over(past).alias("before"), F.sum("n").over(past).alias("rows"))
    own = Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, -1)
    done = dealt.withColumns({"here": F.sum("n_tokens").over(own), "k": F.count("*").over(own)}).join(F.broadcast(before), "part")
    none = F.lit(0)
    done = done.withColumns({"start": F.coalesce("before", none) + F.coalesce("here", none), "row": F.coalesce("rows", none) + F.coalesce("k", none)})
    done.sortWithinPartitions("part", "row").drop("part", "before", "here", "rows", "k").write.parquet(f"{path}/recipes")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n, body) of a store."""
    return spark.read.schema("kind string, digest binary, n int, body binary").parquet(f"{path}/raw").where("kind = 'chunk'").select("digest", "n", "body")


def checked(chunk_table: DataFrame) -> DataFrame:
    """(digest, n, crc) of every chunk as read back; fails where a body is not what its digest says."""

    def run(batches):
        for batch in batches:
            crc = []
            for digest, n, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hashlib.sha256(body).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                ids = np.frombuffer(body, "<u2" if len(body) == 2 * n else "<u4")
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crc, pa.int64())], names=["digest", "n", "crc"])

    return chunk_table.mapInArrow(run, "digest binary, n int, crc long")


def _leaves(spark: SparkSession, path: str) -> DataFrame:
    recipes = spark.read.parquet(f"{path}/recipes")
    return recipes.select("row", "doc_id", "start", "n_tokens", "root", F.posexplode_outer("leaves").alias("pos", "digest"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_chunks) of every document from the files alone.

    The CRC of a document is joined from those of its chunks, so bodies are read once
    and never shuffled; counts and Merkle roots must agree.
    """
    found = _leaves(spark, path).join(checked(chunks(spark, path)), "digest", "left")
    parts = F.filter(F.sort_array(F.collect_list(F.struct("pos", "crc", "n", "digest"))), lambda x: x["pos"].isNotNull())
    by_doc = found.groupBy("row").agg(F.first("start").alias("start"), F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), parts.alias("parts")).drop("row")

    def run(batches):
        for batch in batches:
            out = []
            for start, key, n, root, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if merkle([p["digest"] for p in parts]) != root or sum(p["n"] or 0 for p in parts) != n:
                    raise ValueError(f"document {key} cannot be rebuilt")
                out.append((key, start, n, joined_crc([(p["crc"], 4 * p["n"]) for p in parts]), len(parts)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(1).type), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks"])

    kind = by_doc.schema["doc_id"].dataType.simpleString()
    return by_doc.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, n_chunks long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids array<int>) rebuilt from recipes and chunks."""
    found = _leaves(spark, path).join(chunks(spark, path), "digest", "left")
    parts = F.filter(F.sort_array(F.collect_list(F.struct("pos", "n", "body"))), lambda x: x["pos"].isNotNull())
    by_doc = found.groupBy("row").agg(F.first("start").alias("start"), F.first("doc_id").alias("doc_id"), parts.alias("parts")).drop("row")

    def run(batches):
        for batch in batches:
            ids = [np.concatenate([np.empty(0, "<u2"), *(np.frombuffer(p["body"], "<u2" if len(p["body"]) == 2 * p["n"] else "<u4") for p in parts)]).astype(np.int32) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return by_doc.mapInArrow(run, f"doc_id {by_doc.schema['doc_id'].dataType.simpleString()}, start long, ids array<int>")


def store(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2) -> DataFrame:
    """Write a store in the shared folder and return its manifest."""
    path = place(docs.sparkSession, "idstore")
    write_store(docs, path, tokenizer_path, end_id)
    return manifest(docs.sparkSession, path)
