"""Operator 3: media columns sniffed by their signatures.

An Aho-Corasick automaton finds every magic number in one pass over the bytes; a
validator for each format then checks structure and reads the length, so that chance
magic numbers fall away. The format at offset 0 corrects the declared type, and
validated objects further in are carved. `store` keeps any bytes losslessly as 8-bit
samples of a WAV; `read_back` returns the payload of the stored object.

Nulls count as empty bytes; empty values have no format; equal bytes give equal
results; values are handled whole and one at a time; an empty table gives an empty result; extra columns stay, but
those that `sniff` and `carve` add stand in place of columns of the same names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tidemark.llm.shared import place as new_place
from tidemark.llm.textblock import column_bytes

#: Magic bytes, the offset at which they stand, the format.
MAGIC = (
    (b"RIFF", 0, "audio/wav"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
)
UNIT, RATE = 192, 16000
#: Bytes inflated at once.
PIECE = 1 << 20


def _wav(b: bytes, at: int) -> int:
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    total = 8 + struct.unpack_from("<I", b, at + 4)[0]
    return total if at + total <= len(b) and b[at + 12 : at + 16] == b"fmt " and _chunk(b, at, total, b"data") else 0


def _chunk(b: bytes, at: int, total: int, name: bytes) -> tuple[int, int] | None:
    """Start and length of a RIFF chunk."""
    p = at + 12
    while p + 8 <= at + total:
        n = struct.unpack_from("<I", b, p + 4)[0]
        if p + 8 + n > at + total:
            return None
        if b[p : p + 4] == name:
            return p + 8, n
        p += 8 + n + n % 2
    return None


def _png(b: bytes, at: int) -> int:
    p = at + 8
    if b[p + 4 : p + 8] != b"IHDR":
        return 0
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + n > len(b) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if len(b) < at + 14:
        return 0
    p = at + 13 + (3 * 2 ** ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p += 2
        elif b[p] == 0x2C and p + 10 < len(b):
            p += 10 + (3 * 2 ** ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0) + 1
        else:
            return 0
        while p < len(b) and b[p]:
            p += 1 + b[p]
        p += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind = b[p + 1]
        if not (0xC0 <= kind <= 0xFE):
            return 0
        n = struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return 0
        p += 2 + n
        if kind == 0xDA:  # samples follow, up to the end mark
            end = b.find(b"\xff\xd9", p)
            return end + 2 - at if end >= 0 else 0
    return 0


def _pdf(b: bytes, at: int, marks: dict[bytes, list[int]]) -> int:
    end = _next(marks[b"%%EOF"], at)
    start = _next(marks[b"startxref"], at)
    return end + 5 - at if end is not None and start is not None and start < end else 0


def _zip(b: bytes, at: int, marks: dict[bytes, list[int]]) -> int:
    end = _next(marks[b"PK\x05\x06"], at)
    if end is None or end + 22 > len(b):
        return 0
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(b) else 0


def _gzip(b: bytes, at: int) -> int:
    """Length of a member whose own checksum holds; it is inflated in steps and not kept."""
    d, rest = zlib.decompressobj(31), memoryview(b)[at:]
    try:
        while not d.eof and rest:
            d.decompress(rest[:PIECE], PIECE)
            used = len(rest[:PIECE]) - len(d.unconsumed_tail) - len(d.unused_data)
            if not used and not d.eof and not d.unconsumed_tail:
                return 0
            rest = rest[used:]
    except zlib.error:
        return 0
    return len(b) - at - len(rest) if d.eof else 0


def _crc(poly: int, bits: int) -> list[int]:
    """The table of a checksum that shifts left."""
    out, top = [], 1 << (bits - 1)
    for k in range(256):
        c = k << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c & top else c << 1
        out.append(c & ((1 << bits) - 1))
    return out


_CRC8, _CRC16, _CRC32 = _crc(0x07, 8), _crc(0x8005, 16), _crc(0x04C11DB7, 32)


def _sum8(b: bytes) -> int:
    c = 0
    for x in b:
        c = _CRC8[c ^ x]
    return c


def _frame_head(b: bytes, at: int) -> int:
    """Bytes of the header of a FLAC frame at `at`, 0 where its own checksum says that there is none."""
    if len(b) < at + 6 or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or b[at + 2] >> 4 == 0 or b[at + 2] & 15 == 15:
        return 0
    lead = b[at + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1  # of a number in the style of UTF-8
    n = 5 + more + {6: 1, 7: 2}.get(b[at + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(b[at + 2] & 15, 0)
    return n + 1 if len(b) > at + n and more <= 6 and _sum8(b[at : at + n]) == b[at + n] else 0


def _flac(b: bytes, at: int) -> int:
    """Length up to the last frame whose checksum holds; without frames, that of the metadata."""
    if len(b) < at + 42 or b[at + 4] & 0x7F != 0 or b[at + 5 : at + 8] != b"\0\0\x22":
        return 0
    p, last = at + 4, False
    while not last:
        if p + 4 > len(b):
            return 0
        last = bool(b[p] & 0x80)
        p += 4 + int.from_bytes(b[p + 1 : p + 4], "big")
    if p > len(b):
        return 0
    done = p
    if not _frame_head(b, p):
        return done - at
    c, k, head = 0, p, p
    while k < len(b):
        # A frame ends where the checksum over all of it, its own included, is 0 and a frame or nothing known follows.
        if c == 0 and k > head + 6 and k - head >= 8:
            done = k
            if not _frame_head(b, k):
                break
            head = k
        c = ((c << 8) & 0xFF00) ^ _CRC16[(c >> 8) ^ b[k]]
        k += 1
    return (k if c == 0 and k == len(b) and k > head + 6 else done) - at


def _ogg(b: bytes, at: int) -> int:
    """Length of the run of pages whose checksums hold."""
    p = at
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS" and b[p + 4] == 0 and p + 27 + b[p + 26] <= len(b):
        end = p + 27 + b[p + 26] + sum(b[p + 27 : p + 27 + b[p + 26]])
        if end > len(b):
            break
        c = 0
        for x in b[p : p + 22] + b"\0\0\0\0" + b[p + 26 : end]:
            c = ((c << 8) & 0xFFFFFFFF) ^ _CRC32[(c >> 24) ^ x]
        if c != struct.unpack_from("<I", b, p + 22)[0]:
            break
        p = end
    return p - at


VALIDATORS = {"audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "application/gzip": _gzip, "audio/flac": _flac, "audio/ogg": _ogg}
#: Validators of formats that end with a mark; the marks are found in the same pass as the magic numbers.
MARKED = {"application/pdf": _pdf, "application/zip": _zip}
MARKS = (b"%%EOF", b"startxref", b"PK\x05\x06")


def _next(places: list[int], at: int) -> int | None:
    k = bisect_left(places, at)
    return places[k] if k < len(places) else None


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, _, kind in MAGIC:
        a.add_word(magic.decode("latin-1"), (magic, kind))
    for mark in MARKS:
        a.add_word(mark.decode("latin-1"), (mark, None))
    a.make_automaton()
    return a


def objects(b: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, format) of every validated object, outermost first; objects inside another are found too."""
    found, marks = [], {m: [] for m in MARKS}
    for end, (word, kind) in automaton().iter(b.decode("latin-1")):
        at = end - len(word) + 1
        if kind is None:
            marks[word].append(at)
        else:
            found.append((at, kind))
    out = []
    for at, kind in found:
        size = MARKED[kind](b, at, marks) if kind in MARKED else VALIDATORS[kind](b, at)
        if size:
            out.append((at, size, kind))
    return sorted(out, key=lambda x: (x[0], -x[1]))


def as_wav(payload: bytes) -> bytes:
    """Any bytes as one channel of unsigned 8-bit samples."""
    pad = b"\0" * (len(payload) % 2)
    fmt = struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + len(pad)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(payload)) + payload + pad


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, declared, n_bytes, media): each text, padded with spaces to a multiple of 192 bytes, as a WAV."""

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i in range(0, len(batch), 512):
                media, sizes = [], []
                for a, b in zip(offsets[i : i + 512], offsets[i + 1 : i + 513], strict=False):
                    n = int(b - a)
                    sizes.append(n)
                    media.append(as_wav(data[a:b].tobytes() + b" " * (max(UNIT, -(-n // UNIT) * UNIT) - n)))
                k = len(sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, k), pa.array(["application/octet-stream"] * k), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "declared", "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, declared string, n_bytes long, media binary")


def stored(media: DataFrame) -> DataFrame:
    """`media` written as a compressed Parquet table in the shared folder and read back: what is sniffed is what was stored."""
    spark, path = media.sparkSession, new_place(media.sparkSession, "media")
    media.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(media.schema).parquet(path)


def sniff(df: DataFrame, media_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """`df` with detected (format at offset 0), corrected (is the declared type wrong?) and objects (all that were validated)."""
    df = df.drop("detected", "corrected", "objects")
    names = df.columns
    place, said = names.index(media_col), names.index(declared_col)

    def run(batches):
        for batch in batches:
            found = [objects(b or b"") for b in batch.column(place).to_pylist()]
            top = [next((k for at, _, k in x if at == 0), None) for x in found]
            wrong = [t is not None and t != d for t, d in zip(top, batch.column(said).to_pylist(), strict=True)]
            listed = pa.array([[{"offset": a, "length": n, "format": k} for a, n, k in x] for x in found], pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("format", pa.string())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(top, pa.string()), pa.array(wrong), listed], names=[*names, "detected", "corrected", "objects"])

    one = StructType().add("offset", "long").add("length", "long").add("format", "string")
    return df.mapInArrow(run, StructType(list(df.schema.fields)).add("detected", "string").add("corrected", "boolean").add("objects", ArrayType(one)))


def carve(sniffed: DataFrame, media_col: str = "media") -> DataFrame:
    """One row for each validated object: its format, offset, length and bytes, beside the other columns."""
    own = [c for c in sniffed.columns if c not in (media_col, "objects", "offset", "length", "format", "object")]
    df = sniffed.select(F.struct(*own).alias("row"), F.col(media_col).alias("media"), F.explode("objects").alias("o"))
    cut = F.substring(F.col("media"), (F.col("o.offset") + 1).cast("int"), F.col("o.length").cast("int"))
    return df.select(*[F.col(f"row.`{c}`") for c in own], "o.offset", "o.length", "o.format", cut.alias("object"))


def read_back(b: bytes) -> bytes:
    """The payload of a stored WAV."""
    at, n = _chunk(b, 0, len(b), b"data")
    return b[at : at + n]


def features(sniffed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and a feature string of every stored payload, from the stored bytes as they were sniffed."""

    def run(batches):
        for batch in batches:
            out = []
            for key, n, b, kind, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = read_back(b)
                x = np.frombuffer(payload, np.uint8)
                mean, var = float(x.mean()), float(x.var())
                rises = int(np.count_nonzero((x[1:] >= 96) != (x[:-1] >= 96)))
                inner = sum(1 for o in found if o["offset"])
                out.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(b), hashlib.sha256(b).hexdigest(), f"{kind};samples={len(x)};mean={mean:.4f};var={var:.4f};crossings={rises};min={x.min()};max={x.max()};carved={inner}"))
            kinds = (batch.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = sniffed.schema[id_col].dataType.simpleString()
    return sniffed.select(id_col, "n_bytes", "media", "detected", "objects").mapInArrow(run, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
