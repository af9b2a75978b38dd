"""Operator 5: WARC archives, index first.

Records are rows of text that Spark's own writer commits: a row is a header and a
payload, and the row separator is the two line ends that close a WARC record. An
index of archive, offset, length, URL and digest is then built from the headers and
written; selected records are read as sorted byte ranges that are coalesced where
they touch, straight from the archives' file system, so archives are never shuffled.
Among records of equal payloads the one with the largest key is the response and
the others revisit it; payloads below `least` bytes are always responses.

A body meets its digest's verdict compressed and once. Digests that hold more than one
row in `COMMON` (there are at most that many) are broadcast, so that the copies of a
common page neither meet in one task nor travel with their bodies; all others have few rows.

A null payload is empty. A null key sorts below all others and reads back as null; an
empty text key stays empty. Of repeated rows with the largest key each is a response.
Control characters, blanks, `<`, `>` and `%` of keys and URLs are percent-encoded, and
come back as they were. An empty table gives an empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import place, written
from tidemark.llm.textblock import column_bytes

END = "\r\n\r\n"
#: Ranges that lie closer than this many bytes are read as one.
NEAR = 64 << 10
#: Bytes of an archive, about, and of the ranges that one task reads.
ARCHIVE, SHARE = 256 << 20, 32 << 20
#: A digest with more than one row in so many is common.
COMMON = 1000


def digest(payload: bytes) -> str:
    """SHA-1 in bare upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(c: Column) -> Column:
    """Percent-encode what would end or split a header field."""
    for k in [0x25, *range(0x20), 0x20, 0x3C, 0x3E, 0x7F]:
        c = F.replace(c, F.lit(chr(k)), F.lit(f"%{k:02X}"))
    return c


def _plain(c: Column) -> Column:
    """What `_safe` encoded."""
    for k in [*range(0x20), 0x20, 0x3C, 0x3E, 0x7F, 0x25]:
        c = F.replace(c, F.lit(f"%{k:02X}"), F.lit(chr(k)))
    return c


def records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", least: int = 0) -> DataFrame:
    """(record): the WARC record of each page as text without its closing line ends."""
    kind = pages.schema[key].dataType.simpleString()
    text = F.coalesce(F.col(body), F.lit(""))

    def only_digest(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            found = [digest(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(offsets[1:] - offsets[:-1])], names=["key", "digest", "n"])

    def pack(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                data, offsets = column_bytes(part.column(2))
                bodies = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([z.compress(b) for b in bodies], pa.binary()), pa.array([digest(b) for b in bodies], pa.string())], names=["key", "url", "z", "digest"])

    small = pages.select(key, text.alias("body")).mapInArrow(only_digest, f"key {kind}, digest string, n long")
    groups = small.groupBy("digest").agg(F.max("key").alias("first"), F.count("*").alias("copies"), F.max("n").alias("n"))
    groups = written(groups.where("copies > 1"), "copies")
    rows = pages.count()
    again = groups.where(F.col("n") >= least)
    common = again.where(F.col("copies") * COMMON > rows).select(F.col("digest").alias("_c"), F.col("first").alias("_first"))
    rare = again.where(F.col("copies") * COMMON <= rows).select(F.col("digest").alias("_d"), "first")
    packed = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url), F.lit("")).alias("url"), text.alias("body")).mapInArrow(pack, f"key {kind}, url string, z binary, digest string")
    packed = packed.join(F.broadcast(common), F.col("digest") == F.col("_c"), "left")  # at most COMMON rows
    other = lambda c: F.col(c).isNotNull() & ~F.col("key").eqNullSafe(F.col(c))
    # Rows of common digests are settled: they leave their body behind where it is not needed and spread over the tasks.
    packed = packed.withColumns({
        "z": F.when(other("_first"), F.lit(None)).otherwise(F.col("z")),
        "at": F.when(F.col("_c").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("key", "url").cast("string"))),
    })
    met = packed.join(rare.hint("merge"), F.col("at") == F.col("_d"), "left").select("key", "url", "digest", "z", F.coalesce("_first", "first").alias("first"))
    met = met.withColumn("z", F.when(other("first"), F.lit(None)).otherwise(F.col("z")))

    def unpack(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                body = pa.array([z.decompress(x) if x is not None else b"" for x in part.column(3).to_pylist()], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], body, part.column(4)], names=["key", "url", "digest", "body", "first"])

    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(_safe(F.col(c).cast("string")), F.lit("%")), F.lit(">"))  # noqa: E731  (a lone % is null)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(other("first"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name("key")),
        line("WARC-Target-URI", _safe(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(other("first"), F.concat(line("WARC-Refers-To", name("first")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Length", F.octet_length("body").cast("string")),
        F.lit("\r\n"),
    )
    met = met.mapInArrow(unpack, f"key {kind}, url string, digest string, body string, first {kind}")
    return met.select(F.concat(head, F.col("body")).alias("record"))


def write_archives(pages: DataFrame, path: str, body: str = "html", **options) -> None:
    """Archives of many records each at `path`, by Spark's text writer; an archive has about ARCHIVE bytes at most where records are alike."""
    mean = pages.agg(F.coalesce(F.avg(F.coalesce(F.octet_length(body), F.lit(0)) + 512), F.lit(512.0))).first()[0]
    records(pages, body=body, **options).write.option("lineSep", END).option("maxRecordsPerFile", max(1, int(ARCHIVE / mean))).text(path)


_HEAD = re.compile(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", re.S)


def _fields(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n") if ": " in x)


def _id(value: str | None) -> str | None:
    found = value[len("<urn:page:") : -1] if value else None
    return None if found == "%" else found


_INDEX = "archive string, offset long, length long, url string, digest string, kind string, id string, refers_to string, payload_length long"


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """(archive, offset, length, url, digest, kind, id, refers_to, payload_length) of every record, from the headers of whole archives."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = content.as_buffer()
                view, at, rows = memoryview(b), 0, []
                while at < len(view):
                    m = _HEAD.match(view, at)
                    if not m:
                        raise ValueError(f"no record at {at} of {name}")
                    f = _fields(m[1])
                    n = int(f["Content-Length"])
                    end = m.end() + n
                    if bytes(view[end : end + 4]) != b"\r\n\r\n":
                        raise ValueError(f"record at {at} of {name} has a wrong length")
                    rows.append((name, at, end + 4 - at, f.get("WARC-Target-URI", ""), f["WARC-Payload-Digest"][5:], f["WARC-Type"], _id(f["WARC-Record-ID"]), _id(f.get("WARC-Refers-To")), n))
                    at = end + 4
                    if len(rows) >= 4096:
                        yield _indexed(rows)
                        rows = []
                if rows:
                    yield _indexed(rows)

    found = files.mapInArrow(run, _INDEX)
    return found.withColumns({"url": _plain(F.col("url")), "id": _plain(F.col("id")), "refers_to": _plain(F.col("refers_to"))})


def _indexed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64())
    names = ["archive", "offset", "length", "url", "digest", "kind", "id", "refers_to", "payload_length"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The index of the archives at `path`, as a table beside them that is written once."""
    at = f"{path.rstrip('/')}.index"
    try:
        return spark.read.schema(_INDEX).parquet(at)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    scanned(spark, path).write.parquet(at)
    return spark.read.schema(_INDEX).parquet(at)


def coalesced(ranges: list[tuple[int, int]], near: int = NEAR) -> list[tuple[int, int]]:
    """Sorted (offset, length) ranges joined where they overlap or lie within `near` bytes."""
    out: list[list[int]] = []
    for at, n in sorted(ranges):
        if out and at <= out[-1][1] + near:
            out[-1][1] = max(out[-1][1], at + n)
        else:
            out.append([at, at + n])
    return [(a, b - a) for a, b in out]


def _open(name: str):
    """An archive for reading at any place, by its URI."""
    from urllib.parse import quote

    from pyarrow import fs

    if re.match(r"(file:/|/)", name):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/*", "/", name))
    store, at = fs.FileSystem.from_uri(quote(name, safe=":/@?=&"))
    return store.open_input_file(at)


def read_records(spark: SparkSession, selected: DataFrame) -> DataFrame:
    """Payloads of the selected index rows, checked against their digests.

    Ranges are grouped by archive and stretch of SHARE bytes, sorted, coalesced and read; the rest of an archive is not touched.
    The store must be one that pyarrow opens by URI (local or shared folders, HDFS, S3, GCS).
    """
    stretch = F.floor(F.col("offset") / SHARE)
    n_bytes = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = selected.select("archive", stretch.alias("stretch"), "offset", "length").repartition(max(2 * spark.sparkContext.defaultParallelism, n_bytes // (4 * SHARE)), "archive", "stretch")
    wanted = dealt.groupBy("archive", "stretch").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges")).select("archive", "ranges")  # as many as SHARE bytes hold

    def run(batches):
        for batch in batches:
            for name, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                want = [(r["offset"], r["length"]) for r in ranges]
                rows, k = [], 0
                with _open(name) as file:
                    for start, n in coalesced(want):
                        file.seek(start)
                        block = file.read(n)
                        while k < len(want) and want[k][0] < start + n:
                            at, length = want[k]
                            record = block[at - start : at - start + length]
                            m = _HEAD.match(record)
                            if not m:
                                raise ValueError(f"no record at {at} of {name}")
                            f = _fields(m[1])
                            payload = record[m.end() : -4]
                            if f["WARC-Type"] == "response" and digest(payload) != f["WARC-Payload-Digest"][5:]:
                                raise ValueError(f"the record at {at} of {name} is damaged")
                            rows.append((name, at, f["WARC-Type"], _id(f["WARC-Record-ID"]), _id(f.get("WARC-Refers-To")), f["WARC-Payload-Digest"][5:], payload))
                            k += 1
                            if len(rows) >= 512:
                                yield _rows(rows)
                                rows = []
                if rows:
                    yield _rows(rows)

    found = wanted.mapInArrow(run, "archive string, offset long, kind string, id string, refers_to string, digest string, payload binary")
    return found.withColumns({"id": _plain(F.col("id")), "refers_to": _plain(F.col("refers_to"))})


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "offset", "kind", "id", "refers_to", "digest", "payload"])


def round_trip(pages: DataFrame, key: str = "page_id", **options) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of every page, read back from the archives.

    A revisit has no payload; its size is that of the response with its digest, by the index.
    """
    spark, path = pages.sparkSession, place(pages.sparkSession, "warc")
    write_archives(pages, path, key=key, **options)
    kind = pages.schema[key].dataType
    listed = index(spark, path)
    got = read_records(spark, listed).select("kind", "id", "refers_to", "digest", F.octet_length("payload").cast("long").alias("n"))
    # Only responses that are revisited are met, by their digest: a revisit has no size of its own.
    sizes = listed.where("kind = 'response'").groupBy(F.col("digest").alias("_d")).agg(F.max("payload_length").alias("full"))
    revisited = listed.where("kind = 'revisit'").groupBy(F.col("digest").alias("_d")).agg(F.count("*").alias("times"))
    sizes = written(revisited.join(sizes, "_d"), "sizes")
    n = listed.count()
    common = sizes.where(F.col("times") * COMMON > n).select(F.col("_d").alias("_c"), F.col("full").alias("_full"))  # at most COMMON rows
    rare = sizes.where(F.col("times") * COMMON <= n).select("_d", "full")
    met = got.join(F.broadcast(common), (F.col("kind") == "revisit") & (F.col("digest") == F.col("_c")), "left")
    at = F.when((F.col("kind") == "revisit") & F.col("_c").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), F.xxhash64("id").cast("string")))
    met = met.withColumn("at", at).join(rare, F.col("at") == F.col("_d"), "left")
    size = F.when(F.col("kind") == "response", F.col("n")).otherwise(F.coalesce("_full", "full"))
    return met.select(F.col("id").cast(kind).alias(key), size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))
