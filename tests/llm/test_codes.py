"""Operators 11 to 13 against brute force, their SQL, and the library that they follow."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import anchors, manifest, queries, rankmerge

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_merkle_manifest"])
def test_query_equals_sql(spark, name, sf):
    con = duckdb.connect()
    for f in Path(f"/root/testdata/{sf}").glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, f"/root/testdata/{sf}").select(*names)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def _vectors():
    r = np.random.default_rng(8)
    rows = [(int(k), (r.normal(0, 0.1, 16) + (k % 5) / 4).astype(np.float32).tolist(), int(k % 3) if k % 7 else None) for k in range(300)]
    rows += [(300 + k, [0.25] * 16, 1) for k in range(40)] + [(5, rows[5][1], 2), (None, [0.5] * 16, None), (None, [0.5] * 16, 1)]
    return rows + [(400, None, 1), (401, [None] + [0.0] * 15, 1), (402, [float("nan")] + [0.0] * 15, 1), (403, [float("-inf")] * 16, 1), (404, [], 1), (405, [1.0] * 8, 1), (406, [1.0] * 3, 1)]


def _codes(rows, parts=8, entries=16, rounds=6):
    """The codes by comparing each part with each entry."""
    good = [(k, [int(np.floor(np.float64(np.float32(x)) * 4096)) for x in v], label) for k, v, label in rows if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([v for _, v, _ in good]).reshape(len(good), parts, -1).transpose(1, 0, 2)
    books = x[:, :entries].copy()
    near = lambda p: ((x[p][:, None] - books[p][None]) ** 2).sum(2)
    for _ in range(rounds):
        for p in range(parts):
            owner = near(p).argmin(1)
            for e in set(owner.tolist()):
                books[p, e] = x[p][owner == e].sum(0) // (owner == e).sum()
    d = [near(p) for p in range(parts)]
    error = sum(a.min(1) for a in d)
    by = defaultdict(int)
    for (_, _, label), e in zip(good, error, strict=True):
        by[label] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return Counter((k, "".join("%02x" % a[i].argmin() for a in d), int(error[i]), by[label], digest) for i, (k, _, label) in enumerate(good))


def test_vector_codes(spark, monkeypatch):
    monkeypatch.setattr(anchors, "CHUNK", 100)
    monkeypatch.setattr(anchors, "LEAF", 4)
    columns = "vec_id long, embedding array<float>, label int, id string, v string, code string, ints string"
    for rows in (_vectors(), _vectors()[:3], [(1, [0.5] * 16, None)] * 30, _vectors()[-7:-2], []):
        df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], columns).repartition(3)
        got = anchors.coded(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
        assert Counter(map(tuple, got.collect())) == (_codes(rows) if rows and rows[0][1] else Counter())


def test_balls_are_owned_and_bounds_hold(monkeypatch):
    monkeypatch.setattr(anchors, "LEAF", 8)
    r = np.random.default_rng(1)
    for spread, entries in ((1, 16), (40, 16), (400, 3)):
        centres = r.integers(-2000, 2000, (12, 4))
        x = centres[r.integers(0, 12, 3000)] + r.integers(-spread, spread + 1, (3000, 4))
        tree = anchors.Tree(x)
        for a, b in zip(tree.first, tree.last, strict=True):
            assert a < b
        d = np.sqrt(((x[tree.order] - tree.centre[0]) ** 2).sum(1))
        assert d.max() <= tree.radius[0]
        book = np.r_[centres, x[:4], x[:1]][:entries]  # with an entry twice: ties
        want = ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)
        assert (tree.assigned(book) == want).all()
        count, total = tree.gathered(book)
        assert (count == np.bincount(want, minlength=len(book))).all() and (total.sum(0) == x.sum(0)).all()
        again = anchors.Tree.unpacked(tree.packed(), x, len(tree.first))
        assert (again.assigned(book) == want).all()
        owned, _, points, _ = tree.owners(centres[:3])
        assert len(points) < len(x) and len(owned)


def test_layout_is_van_emde_boas():
    size = lambda levels: (16**levels - 1) // 15
    for levels in range(1, 6):
        for n in (1, 2, 15, 16, 17, 255, 256, 257, 4097, 16 ** (levels - 1)):
            if n > 16 ** (levels - 1) or n == 0:
                continue
            at = manifest.layout(n, levels)
            assert sorted(np.concatenate(at)) == list(range(sum(map(len, at)))) and at[0][0] == 0
    for levels in range(2, 6):  # a full tree: the upper half fills the first places, each lower tree the next
        at, upper = manifest.layout(16 ** (levels - 1), levels), levels // 2
        assert max(a.max() for a in at[:upper]) == size(upper) - 1
        for k in (0, 3):
            low = [a[k * 16 ** d : (k + 1) * 16 ** d] for d, a in enumerate(at[upper:])]
            begin = size(upper) + k * size(levels - upper)
            assert sorted(np.concatenate(low)) == list(range(begin, begin + size(levels - upper)))


H = lambda x: hashlib.sha256(x.encode()).hexdigest()


def _root(nodes, at):
    """(root, [(siblings left, right)] of each leaf of `at`)"""
    steps = {i: [] for i in range(len(nodes))} if at else {}
    place = dict.fromkeys(steps)
    for i in steps:
        place[i] = i
    while len(nodes) > 1:
        for i, s in steps.items():
            p = place[i]
            run = nodes[p // 16 * 16 : p // 16 * 16 + 16]
            s.append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
            place[i] = p // 16
        nodes = [H("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], steps


def _manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, text: H(field(d[0]) + field(d[1]) + field(d[2]) + field(d[3]) + field(text))
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = defaultdict(list)
    for d in rows:
        groups[d[1]].append((d[0] is not None, d[0] or 0, leaf(d, d[4]), d))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {g: _root([x[2] for x in sorted(groups[g])], True) for g in order}
    root, upper = _root([inner[g][0] for g in order], True)
    out = Counter()
    for k, g in enumerate(order):
        for i, (_, _, own, d) in enumerate(sorted(groups[g])):
            steps = inner[g][1][i] + upper[k]
            cur = leaf(d, lower(d[4])) if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 else own
            for a, b in steps:
                cur = H(a + cur + b)
            out[d[0], own, inner[g][0], root, H("".join(a + b for a, b in steps)), cur, cur == root] += 1
    return out


@pytest.mark.parametrize("edges", [1, 2, 3])
def test_manifest(spark, monkeypatch, edges):
    monkeypatch.setattr(manifest, "EDGES", edges)
    r = random.Random(edges)
    source = lambda k: None if k % 9 == 0 else "" if k % 11 == 0 else "hot" if k % 3 else f"é{k % 37}"
    rows = [(k, source(k), None if k % 4 else "en", None if k % 5 == 0 else k, None if k % 13 == 0 else "" if k % 17 == 0 else "Word Ä é " * r.randint(1, 9)) for k in range(700)]
    rows += [(None, "hot", None, 1, "A")] * 3 + [(8, "hot", None, 8, "same")] * 20 + [(9, "hot", "x", 9, "long Text " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    df = df.withColumns({c: F.lit("mine") for c in ("group", "digest", "pos", "n", "block", "salt", "leaf", "root", "id")}).repartition(5)
    got = Counter(map(tuple, manifest.manifest(df).collect()))
    assert got == _manifest(rows) and any(not k[-1] for k in got)
    assert manifest.manifest(df.limit(0)).count() == 0
    (alone,) = manifest.manifest(df.where("lang = 'x'")).collect()
    assert alone.leaf == alone.subroot == alone.root and alone.proof_sha256 == H("")


def test_ranks(spark, monkeypatch):
    ids = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
    r = random.Random(4)
    pool = "abeot  \n\t'sé中文՘֋\U00011de00٣¹ⅷ\x1c\x85 　-_#🙂"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += ["a" * n for n in (1, 2, 255, 256, 257, 3000)] + ["ab" * 3000, "".join(r.choice("etaoinshr") for _ in range(9000)), "中" * 700, " " * 3000, "!" * 2000, "🙂" * 99]
    texts += [None, "", "<|endoftext|>", "I'll we've don't", "same row", "same row", "very long text, " * 60_000]
    monkeypatch.setattr(rankmerge, "BLOCK", 1 << 16)
    enc = rankmerge.Ranks(RANKS, PATTERN)
    monkeypatch.setattr(rankmerge, "KEPT", 50)  # what is kept is thrown out again and again
    for lo in range(0, len(texts), 50):
        some = [t or "" for t in texts[lo : lo + 50]]
        assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(some)] == [library.encode_ordinary(t) for t in some]
    df = spark.createDataFrame([(k if k % 3 else None, t, "clash", "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens string").repartition(4)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((k if k % 3 else None, len(x := library.encode_ordinary(t or "")), sha(np.array(x, "<u4").tobytes()), sha((t or "").encode())) for k, t in enumerate(texts))
    assert Counter(map(tuple, rankmerge.round_trip(df, RANKS, PATTERN).collect())) == want
    assert rankmerge.round_trip(df.limit(0), RANKS, PATTERN).count() == 0
    with pytest.raises(Exception, match="no token"):
        rankmerge.decoded(spark.createDataFrame([(bytearray(b"\xff\xff\xff\x00"),)], "ids binary"), RANKS, PATTERN).collect()


def test_pieces_of_all_widths_merge_alike():
    enc = rankmerge.Ranks(RANKS, PATTERN)
    r = random.Random(6)
    pieces = ["".join(r.choice("aeinorst") for _ in range(n)).encode() for n in range(2, 256) for _ in range(2)]
    heap = [np.array([enc.id[p]] if p in enc.id else enc.by_heap(p), "<u4").tobytes() for p in pieces]
    assert enc.merged(pieces) == heap
