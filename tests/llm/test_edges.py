"""Edge tables for all ten operators, brute force for those without SQL, and the chain of stages."""

import datetime
import gzip
import hashlib
import io
import itertools
import math
import random
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, idstore, lattice, media, mixing, probminhash, quality, rules, suffixes, warc
from tidemark.llm.shared import written

TOKENIZER, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ("_x", "_z", "_rid", "_row", "_times", "_node", "n_words", "size", "taken", "detected", "first", "held_out", "kept", "block")


def _prose(r, n, letters="abcdefghij", width=6):
    return " ".join("".join(r.choice(letters) for _ in range(width)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    a, b = _prose(r, 90), _prose(r, 120)
    texts = [(1, a), (1, b), (1, a), (None, a), (None, _prose(r, 70)), (None, None), (2, ""), (3, None), (4, b + " " + b), (5, "é" * 300), (6, _prose(r, 4000)), (7, "one two three four")]
    return [(k, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else "s", len(t or "")) for i, (k, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Null and repeated ids, repeated rows, and columns that are named as the operators name theirs."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("n_chars").cast("string")) for c in CLASH})


def _same_rows(got, want, columns):
    key = lambda x: tuple((v is None, str(v)) for v in x)
    a, b = (sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) for df in (got, want))
    return a == b


def test_names_that_clash(docs):
    kept = quality.kept(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    assert all(r["n_words"] == f"n_words:{r.n_chars}" for r in kept.collect())
    mix = mixing.sample(docs)
    assert mix.columns == docs.columns and all(r["_times"] == f"_times:{r.n_chars}" for r in mix.collect())
    own = mixing.mixed(docs)
    assert own.count() == docs.count() and {r["_x"] for r in own.collect()} == {r["_x"] for r in docs.collect()}
    cut = suffixes.removed(docs, kinds=(suffixes.passages(51),))
    assert cut.columns == docs.columns and _same_rows(cut, docs, ["doc_id", "_z", "_rid", "_row", "n_chars"])
    one = probminhash.one_of_each(docs)
    assert one.columns == docs.columns and one.where("doc_id is null").count() == 3
    sniffed = media.sniff(media.store(docs).withColumn("detected", F.lit("mine")))
    assert sniffed.where("detected = 'audio/wav'").count() == docs.count()
    assert media.carve(sniffed.withColumn("offset", F.lit("mine"))).where("offset = 0").count() == docs.count()
    scored = rules.scored(docs, rules.fit(docs, docs.select("doc_id", F.lit(1).alias("quality")).limit(0)))
    assert scored.count() == docs.count() and {r["_x"] for r in scored.collect()} == {r["_x"] for r in docs.collect()}
    assert {r.score for r in scored.collect()} == {0.5}


def test_null_and_repeated_ids(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    want = Counter((k, digest(t.encode(x or "", add_special_tokens=False).ids)) for k, x, *_ in rows)
    assert Counter((r.doc_id, r.ids_sha256) for r in bpe.round_trip(docs, TOKENIZER).collect()) == want
    kept = idstore.store(docs, TOKENIZER).collect()
    lengths = Counter((k, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for k, x, *_ in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in kept) == lengths
    order = sorted(kept, key=lambda r: r.start)
    assert [r.start for r in order] == list(itertools.accumulate([0] + [r.n_tokens for r in order][:-1])) and order[0].doc_id is None
    scores = lattice.scores(docs, PIECES).collect()
    assert Counter(r.doc_id for r in scores) == Counter(k for k, *_ in rows)
    assert suffixes.report(docs).count() == quality.verdicts(docs).count() == probminhash.classes(docs).count() == len(rows)
    assert Counter(r.doc_id for r in media.features(media.sniff(media.stored(media.store(docs)))).collect()) == Counter(k for k, *_ in rows)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert quality.kept(none).count() == mixing.sample(none).count() == suffixes.removed(none).count() == probminhash.one_of_each(none).count() == 0
    assert idstore.store(none, TOKENIZER).count() == rules.scored(none, rules.fit(none, none.select("doc_id", F.lit(1).alias("quality")))).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(pages).count() == 0


def test_store_without_end(spark, tmp_path):
    """Without an end id empty documents have no ids and no chunk, and stay; a damaged chunk is noticed."""
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "a b c"), (3, "a b c"), (4, "")], "doc_id long, text string")
    path = str(tmp_path / "store")
    idstore.write_store(docs, path, TOKENIZER, end_id=None)
    got = sorted((r.doc_id, r.n_tokens, r.start) for r in idstore.manifest(spark, path).collect())
    assert got == [(1, 0, 0), (2, 0, 0), (3, 3, 0), (3, 3, 3), (4, 0, 6)]
    assert sorted((r.doc_id, len(r.ids)) for r in idstore.read_ids(spark, path).collect()) == [(1, 0), (2, 0), (3, 3), (3, 3), (4, 0)]
    bad = idstore.chunks(spark, path).withColumn("body", F.concat("body", F.lit(b"\0\0")))
    with pytest.raises(Exception, match="is damaged"):
        idstore.checked(bad).collect()


def _warc_want(rows, least=0):
    groups = defaultdict(list)
    for k, _, html in rows:
        groups[(html or "").encode()].append(k)
    big = lambda ks: max((k for k in ks if k is not None), default=None)
    out = Counter()
    for body, ks in groups.items():
        for k in ks:
            again = len(body) >= least and k != big(ks)
            out[k, len(body), warc.digest(body), "revisit" if again else "response", big(ks) if again else None] += 1
    return out


def test_warc_brute_force(spark, monkeypatch):
    """Null and repeated keys, common and rare digests, and a limit below which nothing is revisited."""
    r = random.Random(3)
    rows = [(k, f"http://h/{k} <x>%0A", "<p>common</p>") for k in range(40)] + [(100 + k, "u\r\n\x00", _prose(r, k % 7)) for k in range(60)]
    rows += [(None, None, "<p>common</p>"), (None, "z", "only"), (500, "z", "twice"), (500, "z", "twice"), (501, "z", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for common, least in ((1000, 0), (4, 0), (4, 12)):
        monkeypatch.setattr(warc, "COMMON", common)
        got = Counter(tuple(x) for x in warc.round_trip(pages, least=least).collect())
        assert got == _warc_want(rows, least)


def test_warc_selection(spark, tmp_path):
    """Selected records alone are read; keys and URLs come back as they were; an empty text key is not a null one."""
    rows = [("a>b", "x y\r\n", "one"), ("", "%41", "two"), (None, "q", "three"), ("d", "q", "four")]
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(2), path)
    listed = warc.index(spark, path)
    assert {(x.id, x.url) for x in listed.collect()} == {(k, u) for k, u, _ in rows}
    assert warc.index(spark, path).count() == 4
    got = warc.read_records(spark, listed.where("url = 'q'")).collect()
    assert {(x.id, bytes(x.payload)) for x in got} == {(None, b"three"), ("d", b"four")}


def _frames(seed: int) -> bytes:
    """A FLAC of two made-up frames with right checksums."""
    info = struct.pack(">HH", 192, 192) + bytes(6) + bytes(8) + bytes(16)
    head = b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info
    out = head
    for k in range(2):
        frame = bytes([0xFF, 0xF8, 0x19, 0x18, k])
        frame += bytes([media._sum8(frame)]) + random.Random(seed + k).randbytes(40)
        c = 0
        for x in frame:
            c = ((c << 8) & 0xFF00) ^ media._CRC16[(c >> 8) ^ x]
        out += frame + c.to_bytes(2, "big")
    return out


def _page(body: bytes) -> bytes:
    head = b"OggS" + bytes([0, 2]) + bytes(8) + bytes(4) + bytes(4) + bytes(4) + bytes([1, len(body)])
    c = 0
    for x in head + body:
        c = ((c << 8) & 0xFFFFFFFF) ^ media._CRC32[(c >> 24) ^ x]
    return head[:22] + struct.pack("<I", c) + head[26:] + body


def test_formats():
    """Every validator reads the length of a real object between other bytes, and turns down a damaged one."""
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr(zipfile.ZipInfo("a", datetime.datetime(2020, 1, 1).timetuple()[:6]), b"hello")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xda" + struct.pack(">H", 3) + b"c" + b"samples" + b"\xff\xd9"
    real = {
        "image/png": png, "application/zip": zipped.getvalue(), "image/gif": gif, "image/jpeg": jpeg, "audio/wav": media.as_wav(b"samples!"),
        "application/gzip": gzip.compress(random.Random(1).randbytes(3_000_000), mtime=0), "application/pdf": b"%PDF-1.4 body startxref 9 %%EOF", "audio/ogg": _page(b"abc") + _page(b"de"), "audio/flac": _frames(4),
    }
    for kind, b in real.items():
        found = media.objects(b"before" + b + b" after")
        assert (6, len(b), kind) in found, (kind, found)
        assert not [x for x in media.objects(b[: len(b) // 2]) if x[0] == 0 and x[2] == kind] or kind == "audio/ogg" or kind == "audio/flac"
    assert media.objects(_page(b"abc")[:-1] + b"x") == [] and (0, len(_page(b"abc")), "audio/ogg") in media.objects(_page(b"abc") + _page(b"de")[:-1])


def _segmentations(p, b):
    if not b:
        yield ()
    for j in range(1, len(b) + 1):
        if b[:j] in p.index:
            for rest in _segmentations(p, b[j:]):
                yield (p.index[b[:j]], *rest)


def test_lattice_brute_force(spark):
    """Marginals against all segmentations of short words, the expectation step too, and every base column against counting."""
    p = lattice.pieces(PIECES)
    words = [b" the", b" token", b" \xc3\xa9ta", b" a", b" zzzq"]
    data, e = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    s = e - [len(w) for w in words]
    counts = np.array([5.0, 1, 2, 3, 1])
    got, expect = lattice.marginals(p, data, s, e, p.first, counts)
    want = np.zeros(len(p.first))
    for k, w in enumerate(words):
        ways = list(_segmentations(p, w))
        each = np.array([p.first[list(x)].sum() for x in ways])
        assert math.isclose(got[k], np.logaddexp.reduce(each))
        for x, q in zip(ways, np.exp(each - got[k]), strict=True):
            np.add.at(want, list(x), counts[k] * q)
    assert np.allclose(expect, want)
    assert p.widest == max(map(len, p.bytes))
    r = random.Random(17)
    texts = [None if k % 11 == 0 else _prose(r, r.randint(0, 30), "abAB", 2) for k in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    token = {k: [*(x.lower() for x in WORD.findall(t or "")), None] for k, t in enumerate(texts)}
    held = {k for k in token if zlib.crc32(str(k).encode()) % 10 == 0}
    c = Counter(x for k, v in token.items() if k not in held for x in v)
    n, v = sum(c.values()), len(c)
    for x in lattice.scores(docs, PIECES).collect():
        mine = token[x.doc_id]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (x.doc_id in held, len(mine), sum(c[w] > 0 for w in mine), n)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in mine), rel_tol=1e-9)


def _classes(texts, alike=0.8):
    sets = [Counter(zip(*(w[i:] for i in range(5)), strict=False)) for w in (WORD.findall(t) for t in texts)]
    found = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = a.keys() & b.keys()
            plain = len(both) / max(1, len(a.keys() | b.keys()))
            even = set(a.values()) | set(b.values()) == {1}
            prob = plain if even else sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in a.keys() | b.keys()) for x in both) if plain > 0.1 else 0
            if max(plain, prob) >= alike and found[i] != found[j]:
                lo, hi = sorted((found[i], found[j]))
                found = [lo if x == hi else x for x in found]
    return found


def test_bands_of_many_components(spark, monkeypatch):
    """Texts over one template that lie below 0.8 of each other share bands in many components; copies of each are near. Bands are cut into chunks."""
    monkeypatch.setattr(probminhash, "CHUNK", 8)
    monkeypatch.setattr(probminhash, "BLOCK", 1 << 12)
    r = random.Random(9)
    template = _prose(r, 160).split()
    texts = []
    for _ in range(14):
        own = list(template)
        at = r.randrange(0, 120)
        own[at : at + 26] = _prose(r, 26).split()
        texts.append(" ".join(own))
        for _ in range(2):
            near = list(own)
            near[r.randrange(160)] = "changed"
            texts.append(" ".join(near))
    texts += [_prose(r, 60) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.class_id for x in probminhash.classes(docs).collect()}
    assert [got[k] for k in range(len(texts))] == _classes(texts)


def test_rules_of_two_classes(spark):
    """Forest, lasso and compiled rules on two classes that a statistic tells apart; held-out rows are never fitted."""
    r = random.Random(2)
    good = lambda: ". ".join(_prose(r, 12, width=5) for _ in range(8))
    bad = lambda: " ".join(r.choice(["BUY!!", "NOW!", "$$$", "deal"]) for _ in range(90))
    rows = [(k, good() if k % 2 else bad()) for k in range(300)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    labels = spark.createDataFrame([(k, (1 - k % 2) if held(k) else k % 2) for k in range(300)] + [(1, None)], "doc_id long, quality int")
    model = rules.fit(docs, labels)
    assert model.rules and model.describe()
    got = {x.doc_id: x for x in rules.scored(docs, model).collect()}
    assert all(got[k].held_out == held(k) and got[k].predicted == (1 if got[k].score >= 0.7 else 0) for k in got)
    assert all(got[k].predicted == k % 2 for k in range(300)) and 0 <= got[1000].score == got[1001].score <= 1


def test_mix_brute_force(spark):
    """Targets by raising one water level, and what each source takes, from the rows alone."""
    r = random.Random(6)
    rows = [(k, _prose(r, r.randint(0, 40)), r.choice(["a", "b", "b", "b", "c", "d", None])) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size, own = {k: len(WORD.findall(t)) for k, t, _ in rows}, Counter()
    for k, _, s in rows:
        own[s] += size[k]
    names = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_ = 1.5 * sum(own.values()), set(names)
    target = {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * own[s] + 1e-9}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * own[s]
            left -= 2 * own[s]
        open_ -= full
    got = mixing.mixed(docs).collect()
    took = Counter()
    for x in got:
        assert x.size == size[x.doc_id] and x.taken in (0, x.size, 2 * x.size) and x.source_size == own[x.source]
        assert math.isclose(x.target, target[x.source])
        took[x.source] += x.taken
    assert all(abs(took[s] - target[s]) <= 40 for s in names)
    assert sorted(map(str, mixing.mixed(docs.repartition(7)).collect())) == sorted(map(str, got))


def test_quality_keeps_and_shrinks(spark):
    """`kept` is the verdict; a source of few documents leans on its language, one of many on itself."""
    r = random.Random(4)
    rows = [(k, _prose(r, 80), "en", "large") for k in range(150)] + [(1000 + k, _prose(r, 80) + " $$$$" * 12, "en", "small") for k in range(5)] + [(2000 + k, _prose(r, 80) + " $$$$" * 12, "en", "many") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    verdict = {x.doc_id: x.kept for x in quality.verdicts(docs).collect()}
    assert {x.doc_id for x in quality.kept(docs).collect()} == {k for k, v in verdict.items() if v}
    counted = written(quality.counts(docs.select("doc_id", "text", "lang", "source")), "counted")
    hi = {x._source: x._hi_symbols for x in quality.thresholds(counted).collect()}
    own = {x.source: x.hi_symbols for x in quality.fences(quality.sketches(counted), ["lang", "source"]).collect()}
    assert abs(hi["many"] - own["many"]) < abs(hi["small"] - own["small"]) * 20 and own["large"] < hi["large"]


def test_chain(spark, tmp_path):
    """The stages in order on one table, each against brute force on what the stage before it kept."""
    r = random.Random(31)
    base, passage = [_prose(r, 140) for _ in range(6)], _prose(r, 55)
    texts = [*base, base[0], base[1] + " tail", "short text", None, base[2] + " " + passage, _prose(r, 90) + " " + passage, ("spam line here\n" * 60).strip()]
    rows = [(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = written(corpus_pipeline.quality_rules(spark, docs, ""), "kept")
    assert {x.doc_id for x in kept.collect()} == {0, 1, 2, 3, 4, 5, 6, 7, 10, 11}
    mine = {x.doc_id: x.text for x in kept.collect()}
    order = sorted(mine)
    label = _classes([mine[k] for k in order])
    one = written(corpus_pipeline.near_duplicates(spark, kept, ""), "one")
    assert {x.doc_id for x in one.collect()} == {order[x] for x in set(label)}
    cut = written(corpus_pipeline.suffix_dedup(spark, one, ""), "cut")
    said = {x.doc_id: x.text for x in cut.collect()}
    seen = Counter(tuple(w[i : i + 51]) for w in (WORD.findall(x.text) for x in one.collect()) for i in range(len(w) - 50))
    for x in one.collect():
        w = WORD.findall(x.text)
        gone = {i + j for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for j in range(51)}
        assert WORD.findall(said[x.doc_id]) == [v for i, v in enumerate(w) if i not in gone]
    mix = corpus_pipeline.mix_sources(spark, cut, "")
    times = {x.doc_id: x.times for x in mixing.mixed(cut).collect()}
    assert Counter(x.doc_id for x in mix.collect()) == Counter({k: v for k, v in times.items() if v})
    assert corpus_pipeline.bpe_round_trip(spark, mix, "").count() == sum(times.values())


def test_encoding_takes_little_memory_beside_its_texts():
    import tracemalloc

    r = np.random.default_rng(5)
    known = np.array(["".join(map(chr, r.integers(97, 123, r.integers(2, 9)))) for _ in range(20_000)])
    raw = [" ".join(known[r.integers(0, len(known), 1000)]).encode() for _ in range(1300)]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(t) for t in raw])]
    enc = bpe.encoder(TOKENIZER)
    tracemalloc.start()
    for i, j in bpe.groups(off, bpe.BLOCK):
        list(bpe.digests(enc, data[off[i] : off[j]], off[i : j + 1] - off[i]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) > 7_000_000 and peak < 110 << 20
