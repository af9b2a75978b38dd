"""Small tables with nulls, empties, repeats and long texts against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, idstore, lattice, media, mixing, probminhash, quality, rules, suffixes, warc

TOKENIZER, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice(["an", "to", "re", "ou", "é", "st"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage = prose(300), prose(120)
    near = base.split()
    near[150] = "changed"
    out = [base, base, " ".join(near), prose(60) + "\n" + passage, passage + " " + prose(70), None, "", "  \n ", "one", "one two <|endoftext|> three", prose(3000), ("x" * 900), "GIF89a and PK\x03\x04 inside", "a line\n" * 80]
    return out + [prose(100) for _ in range(6)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_suffixes(docs, empty):
    texts = [(t or "").encode() for t in _texts()]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    got = _by_id(suffixes.report(docs))
    for k, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(t), gone.sum(), spans, hashlib.sha256(kept).hexdigest())
    cut = _by_id(suffixes.removed(docs))
    assert cut[5].text is None and cut[8].text == "one" and cut[0].score == "clash"
    assert suffixes.report(empty).count() == 0


def test_tokens(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = [t.encode(x or "", add_special_tokens=False).ids for x in _texts()]
    got, kept = _by_id(bpe.round_trip(docs, TOKENIZER)), _by_id(idstore.store(docs, TOKENIZER))
    start = 0
    for k, ids in enumerate(want):
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        whole = [*ids, 2]
        assert (kept[k].start, kept[k].n_tokens, kept[k].ids_crc32) == (start, len(whole), zlib.crc32(np.array(whole, "<u4").tobytes()))
        start += len(whole)
    assert bpe.round_trip(empty, TOKENIZER).count() == 0


def test_media(docs, empty):
    got = _by_id(media.features(media.sniff(media.store(docs))))
    for k, t in enumerate(_texts()):
        b = (t or "").encode()
        pad = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        assert (got[k].n_bytes, got[k].payload_sha256, got[k].tail_crc32) == (len(b), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
    inner = media.as_wav(b"abcd")
    assert [x[0] for x in media.objects(media.as_wav(b"zz" + inner))] == [0, 46] and media.objects(b"RIFF not one") == []
    assert media.features(media.sniff(media.store(empty))).count() == 0


def test_quality(docs, empty):
    got = _by_id(quality.verdicts(docs))
    for k, t in enumerate(_texts()):
        w = WORD.findall(t or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        assert (got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words) == want
        assert got[k].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (got[k].base_failed and got[k].kept)
    assert quality.verdicts(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    total, target = sum(r.size for r in rows), {r.source: r.target for r in rows}
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6
    assert mixing.sample(docs).count() == sum(r.times for r in rows)
    assert mixing.mixed(empty).count() == 0


def test_warc(spark):
    rows = [(1, "u\r\nx", "<p>a</p>"), (2, None, "<p>a</p>"), (3, "v", None), (4, "w", ""), (5, "z", "WARC/1.1\r\n\r\nq"), (6, "z", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert [(got[k].record_type, got[k].refers_to) for k in range(1, 7)] == [("revisit", 2), ("response", None), ("revisit", 4), ("response", None), ("response", None), ("response", None)]
    for k, _, html in rows:
        b = (html or "").encode()
        assert (got[k].payload_bytes, got[k].payload_digest) == (len(b), warc.digest(b))
    assert warc.coalesced([(10, 5), (0, 4), (15, 2)], near=3) == [(0, 4), (10, 7)]


def test_lattice(docs, empty):
    got = lattice.scores(docs, PIECES).collect()
    assert len(got) == docs.count() and all(r.score < 0 and r.n_known <= r.n_tokens for r in got)
    p = lattice.pieces(PIECES)
    words = [b" the", b" thing", b" \xc3\xa9t"]
    data = np.frombuffer(b"".join(words), np.uint8)
    e = np.cumsum([len(w) for w in words])
    fast = lattice.marginals(p, data, e - [len(w) for w in words], e, p.first)[0]
    assert np.allclose(fast, [lattice._long_word(p, w, p.first, None, 0) for w in words])
    assert lattice.scores(empty, PIECES).count() == 0


def test_near_duplicates(docs, empty):
    got = {r.doc_id: r.class_id for r in probminhash.classes(docs).collect()}
    assert got[0] == got[1] == got[2] == 0 and all(got[k] == k for k in range(3, len(got)))
    assert probminhash.one_of_each(docs).count() == docs.count() - 2
    assert probminhash.classes(empty).count() == 0
    assert probminhash.similarity(np.array([1, 2]), np.ones(2), np.array([2, 3]), np.ones(2)) == (1 / 3, 1 / 3)


def test_rules(docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    model = rules.fit(docs, labels)
    assert {round(r.score, 3) for r in rules.scored(docs, model).collect()} == {1.0}
    assert rules.paths("If (feature 1 <= 0.5)\n Predict: 0.0\nElse (feature 1 > 0.5)\n Predict: 1.0") == [((1, True, 0.5),), ((1, False, 0.5),)]


def test_passages(spark):
    """The pipeline's stage: every repeated run of 51 words goes, whatever blanks lie between and however few bytes it has."""
    import corpus_pipeline

    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(n))
    passage, short = prose(51), prose(50)
    wrapped, block = "\n".join(passage.split()), "é" * 210  # 420 bytes in one word
    texts = [prose(60) + " " + passage + " " + prose(9), passage + " " + prose(40), prose(30) + "\n" + wrapped, f"{prose(5)} {short} {prose(5)}", f"{prose(7)} {short}", f"{prose(4)}{block}", f"{block}{prose(3)}", None, "", passage, prose(500)]
    assert len(passage) < 400 and len(short) < 400
    rows = [(k, t, "en", "s", len(t or ""), "clash") for k, t in enumerate(texts)]
    got = _by_id(corpus_pipeline.suffix_dedup(spark, spark.createDataFrame(rows, SCHEMA), ""))
    seen = Counter(tuple(w[i : i + 51]) for w in (WORD.findall(t or "") for t in texts) for i in range(len(w) - 50))
    for k, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = {i + j for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for j in range(51)}
        want = [x.replace(block, "") for i, x in enumerate(w) if i not in gone]
        assert WORD.findall(got[k].text or "") == want and got[k].n_chars == (None if t is None else len(got[k].text))
    assert got[7].text is None and got[9].text == "" and short in got[3].text and short in got[4].text


def test_report_of_copies_and_short_passages(spark):
    """Repeated passages under 400 bytes are counted and not removed; of whole copies all is removed, and they still meet other texts."""
    r = random.Random(9)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(n))
    passage, short, whole, tiny = prose(51), prose(50), prose(300), prose(20)
    texts = [prose(60) + " " + passage + " " + prose(9), prose(30) + "\n" + "\n".join(passage.split()), f"{prose(5)} {short}", f"{short} {prose(5)}", whole, whole, whole, prose(40) + " " + whole[100:900] + " " + prose(3), tiny, tiny, None, "", "", " " + passage + "\t", "x" * 399, "x" * 399, "y" * 400, "y" * 400]
    assert len(passage) < 400 <= len(whole)
    got = _by_id(suffixes.report(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")))
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + 400] for t in raw for i in range(len(t) - 399))
    runs = Counter(tuple(w[i : i + 51]) for w in (WORD.findall(t or "") for t in texts) for i in range(len(w) - 50))
    for k, t in enumerate(texts):
        gone, held = np.zeros(len(raw[k]), bool), np.zeros(len(raw[k]), bool)
        for i in range(len(raw[k]) - 399):
            gone[i : i + 400] |= seen[raw[k][i : i + 400]] > 1
        at = [m.span() for m in WORD.finditer(t or "")]
        for i in range(len(at) - 50):
            held[at[i][0] : at[i + 50][1]] |= runs[tuple(t[a:b] for a, b in at[i : i + 51])] > 1
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        assert (got[k].n_removed, got[k].n_spans, got[k].kept_sha256, got[k].n_passage_bytes) == (gone.sum(), spans, hashlib.sha256(np.frombuffer(raw[k], np.uint8)[~gone].tobytes()).hexdigest(), held.sum())
    assert got[0].n_removed == 0 and got[0].n_passage_bytes == len(passage) and got[2].n_passage_bytes == 0


def _near_classes(texts, alike=0.8):
    """The least place of each text's class, by brute force over all pairs."""
    sets = [Counter(zip(*(w[i:] for i in range(5)), strict=False)) for w in (WORD.findall(t) for t in texts)]
    found = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = a.keys() & b.keys()
            plain = len(both) / len(a.keys() | b.keys())
            prob = sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in a.keys() | b.keys()) for x in both) if plain > 0.1 else 0
            if max(plain, prob) >= alike and found[i] != found[j]:
                lo, hi = sorted((found[i], found[j]))
                found = [lo if x == hi else x for x in found]
    return found


def test_repeated_lines(spark):
    """Copies in which a line occurs once, 20 and 40 times: plain Jaccard is near 1, probability Jaccard far below 0.8."""
    r = random.Random(11)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    texts = []
    for _ in range(12):
        base, line = prose(300), prose(8)
        texts += [base + ("\n" + line) * k for k in (1, 40, 20)]
    shared = prose(300)
    texts += [shared + ("\n" + prose(8)) * k for k in (1, 40)] + [shared + " " + prose(90), prose(20)]
    rows = [(k, t, "en", "s", len(t), "clash") for k, t in enumerate(texts)]
    got = {x.doc_id: x.class_id for x in probminhash.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k] for k in range(len(texts))] == _near_classes(texts)


def test_one_of_each_by_row(spark):
    """Rows of one id with different texts are different rows; equal ones fall together."""
    r = random.Random(12)
    prose = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(100))
    a, b, c = prose(), prose(), prose()
    rows = [(3, a), (5, a), (5, b), (5, b), (6, b), (7, c), (7, prose()), (8, None), (8, None), (None, a)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), "clash") for k, t in rows], SCHEMA).repartition(3)
    got = Counter((x.doc_id, x.text) for x in probminhash.one_of_each(docs).collect())
    assert got == Counter([(3, a), (5, b), *rows[5:8], (None, a)])
