"""Operator 9: near-duplicate classes by ProbMinHash.

Elements are shingles of five words, weighted by how often they occur. Each element
is a Poisson process whose rate is its weight and whose arrivals fall into random
registers; a register keeps the element that arrives first, so two registers agree
with the probability Jaccard similarity of the documents. Arrivals are drawn only up
to a time by which all registers are likely full, and on from there for the few
documents where one is not.

A document in which a shingle occurs twice has a second signature, in which every shingle weighs 1: its registers agree with the
plain Jaccard similarity. For all others both signatures are the same.

The first 80 of 256 registers of a signature are banded (20 bands of 4). Documents of one band meet its leader first and
exact shingles decide: a pair is linked at a probability Jaccard or a plain Jaccard
similarity of 0.8 or more. Bands whose members are one component are done. In the
others every two members of different components are compared by all registers, in
blocks of at most about `CHUNK` members a side. Of the pairs that agree in 62 % by either signature (a pair at 0.8
agrees in fewer registers with probability below 2e-11) exact shingles decide: for the best pair of two components first, for what
is still apart in blocks of the same bands that carry the shingles. Copies with the same
words are one node from the start. No step gathers a band, a link list or a component in one place.

A text of one to four words is one shingle; null texts and texts without words are
classes of their own, as is a null id's; the class id is its least doc_id; repeated
rows are copies; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.shared import written
from tidemark.llm.textblock import Prefix, column_bytes, groups, mix, signed, words

WORDS, ALIKE = 5, 0.8
BANDS, ROWS = 20, 4
#: Registers, the share of them in which a pair must agree to be compared exactly, and members of a band compared at once.
REGISTERS, AGREE, CHUNK = 256, 0.62, 1024
#: Bytes of sets in a chunk where exact shingles are compared.
BLOCK = 16 << 20
STEP, MOST = 1 << 20, 2000
_A = np.uint64(0xD6E8FEB86659FD93)


def shingles(data: np.ndarray, bounds: np.ndarray):
    """(document, hash, weight) of the distinct shingles of each document in order, and a hash of each document's words."""
    s, e, first = words(data, bounds)
    prefix = Prefix(data)
    w = mix(prefix.of(s, e) + (e - s).astype(np.uint64))
    n = np.diff(first)
    k = np.arange(len(w)) - np.repeat(first[:-1], n)
    run = np.r_[np.uint64(0), np.cumsum(mix(w ^ mix(k.astype(np.uint64))))]
    whole = mix(run[first[1:]] - run[first[:-1]] + n.astype(np.uint64))
    size = np.minimum(n, WORDS)
    grams = n - size + (n > 0)
    h = np.zeros(len(w), np.uint64)
    for j in range(WORDS):
        part = np.zeros(len(w), np.uint64)
        part[: max(0, len(w) - j)] = w[j:]
        h = h * _A + np.where(j < np.repeat(size, n), part, np.uint64(0))
    doc = np.repeat(np.arange(len(n)), n)
    real = k < np.repeat(grams, n)
    doc, h = doc[real], mix(h[real])
    if not len(h):
        return doc, h, np.empty(0), whole
    order = np.lexsort((h, doc)) if len(n) > 1 << 15 else _order(doc, h)
    doc, h = doc[order], h[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.r_[at, len(h)]).astype(np.float64), whole


def _order(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """By document, then by hash: documents are already in order, so each is sorted alone through its leading bits."""
    order = np.argsort((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)), kind="stable")
    d, x = doc[order], h[order]
    if len(x) > 1 and ((d[1:] == d[:-1]) & (x[1:] < x[:-1])).any():  # equal leading bits, unequal rest
        return np.lexsort((h, doc))
    return order


def registers(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """The element that arrives first in each of m registers, for each of n documents; 0 for documents without elements."""
    out = np.zeros((n, m), np.uint64)
    total = np.bincount(doc, weight, n)
    todo, spread = total > 0, math.log(m) + 3
    while todo.any():
        limit = np.where(todo, m * spread / np.maximum(total, 1e-300), -1.0)
        best = np.full(n * m, np.inf)
        live, x = np.flatnonzero(todo[doc]), None
        clock, kept, r = np.zeros(len(live)), [], np.uint64(0)
        while len(live):
            z = mix(h[live] + mix(np.full(1, r * np.uint64(2) + np.uint64(1))))
            clock = clock - np.log((((z >> np.uint64(11)).astype(np.float64)) + 0.5) * 2.0**-53) / weight[live]
            go = clock <= limit[doc[live]]
            live, clock, z = live[go], clock[go], z[go]
            at = doc[live] * m + (mix(z + _A) % np.uint64(m)).astype(np.int64)
            np.minimum.at(best, at, clock)
            kept.append((at, clock, live))
            r += np.uint64(1)
        at, x, who = (np.concatenate(c) for c in zip(*kept, strict=True))
        won = x == best[at]
        flat = np.zeros(n * m, np.uint64)
        flat[at[won]] = h[who[won]]
        full = todo & np.isfinite(best.reshape(n, m)).all(axis=1)
        out[full] = flat.reshape(n, m)[full]
        todo, spread = todo & ~full, spread * 2
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """One hash for each band of each document."""
    x = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS)
    h = np.zeros((len(sig), BANDS), np.uint64)
    for j in range(ROWS):
        h = mix(h * _A + x[:, :, j])
    return mix(h + np.arange(BANDS, dtype=np.uint64))


def _signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> list[np.ndarray]:
    """The signatures of each of n documents as rows: the weighted one, and where any weight is not 1 the plain one too."""
    own = registers(doc, h, weight, n)
    uneven = np.bincount(doc, weight != 1, n) > 0
    some = np.flatnonzero(uneven)
    if not len(some):
        return list(own[:, None])
    mine = uneven[doc]
    plain = registers(np.searchsorted(some, doc[mine]), h[mine], np.ones(int(mine.sum())), len(some))
    at = np.cumsum(uneven) - 1
    return [np.stack([own[k], plain[at[k]]]) if uneven[k] else own[k : k + 1] for k in range(n)]


def _parts(off: np.ndarray):
    """Blocks of at most STEP bytes and MOST documents."""
    for i, j in groups(off, STEP):
        for k in range(i, j, MOST):
            yield k, min(k + MOST, j)


def _signed_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, node, bands, marks): node is a hash of the words, marks are the low bytes of the registers of one or two signatures; without words all are null or void."""

    def run(batches):
        for batch in batches:
            data, off = column_bytes(batch.column(1))
            for i, j in _parts(off):
                n = j - i
                doc, h, weight, whole = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
                none = np.bincount(doc, minlength=n) == 0
                sigs = _signatures(doc, h, weight, n)
                at = np.r_[0, np.cumsum([len(x) for x in sigs])].astype(np.int32)
                banded = bands(np.concatenate(sigs))
                node = pa.array(signed(whole), mask=none)
                listed = pa.ListArray.from_arrays(pa.array(at * BANDS, pa.int32()), pa.array(signed(banded).ravel()))
                marks = pa.array([x.astype(np.uint8).tobytes() for x in sigs], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), node, listed, marks], names=["doc_id", "node", "bands", "marks"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, node long, bands array<long>, marks binary")


def _sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, h, w): the sorted shingles of one document of each node of `asked` (doc_id, node); w is empty where all weigh 1."""
    asked = asked.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    both = docs.select("doc_id", "text").join(asked, F.col("doc_id") == F.col("_id")).select("_node", "text")

    def run(batches):
        for batch in batches:
            data, off = column_bytes(batch.column(1))
            want = batch.column(0).to_numpy()
            for i, j in _parts(off):
                doc, h, weight, whole = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
                own = np.flatnonzero(signed(whole) == want[i:j])  # a doc_id may have other texts too
                lo, hi = np.searchsorted(doc, own), np.searchsorted(doc, own, "right")
                yield pa.RecordBatch.from_arrays([
                    pa.array(want[i:j][own]), pa.array([h[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
                    pa.array([b"" if (weight[a:b] == 1).all() else weight[a:b].astype(np.float32).tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
                ], names=["node", "h", "w"])

    return both.mapInArrow(run, "node long, h binary, w binary")


def similarity(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> tuple[float, float]:
    """(probability Jaccard, plain Jaccard) of two sorted weighted sets."""
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0, 0.0
    plain = len(ia) / (len(ha) + len(hb) - len(ia))
    a, b = wa[ia], wb[ib]
    rest_a, rest_b = wa.sum() - a.sum(), wb.sum() - b.sum()
    ratio, of = np.unique(a / b, return_inverse=True)
    whole = np.array([np.maximum(a, b * r).sum() + rest_a + rest_b * r for r in ratio])
    return float((a / whole[of]).sum()), plain


def _arrays(h, w: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of a set as `_sets` packs it."""
    x = np.frombuffer(h, np.uint64)
    return x, np.frombuffer(w, np.float32).astype(np.float64) if w else np.ones(len(x))


def linked(pairs: DataFrame, sets: DataFrame, alike: float = ALIKE) -> DataFrame:
    """Pairs (a, b) that are similar enough by their exact shingles."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("h").alias(f"h{x}"), F.col("w").alias(f"w{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "wa", "hb", "wb")

    def run(batches):
        for batch in batches:
            keep = []
            for ha, wa, hb, wb in zip(*(batch.column(k) for k in (2, 3, 4, 5)), strict=True):
                keep.append(max(similarity(*_arrays(ha.as_buffer(), wa.as_py()), *_arrays(hb.as_buffer(), wb.as_py()))) >= alike)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, for nodes with links. Labels spread to neighbours and jump to their label's label."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        best = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("node").alias("at"), F.col("label").alias("up"))
        jumped = best.join(up, F.col("new") == F.col("at"), "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("up", "new")).alias("label"))
        jumped = written(jumped, "labels")
        labels = jumped.select("node", "label")
        if not jumped.where("label != old").take(1):
            return labels


def _meetings(state: DataFrame, exact: bool = False) -> DataFrame:
    """Pairs (a, b, ca, cb, agree) of one band and different components ca, cb that agree in AGREE of their marks, each from its first common band.

    Without `exact` a block gives only the pair of every two components that agrees most, and with b null the members (band, a) of all its pairs.
    `state` is (band, chunks, pos, node, comp, marks, bands); pos is the place of the band among a document's bands. A large band is cut
    into chunks by hash, and every two chunks meet in a block of their own. With `exact`, `state` has the sets (h, w) as well and
    pairs that are not similar enough by them are left out, so that no table of pairs has to meet the sets.
    """
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = state.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.col("own"), "pos", "node", "comp", "marks", "bands", *(["h", "w"] if exact else []))
    block = ["band", "lo", "hi"]
    dealt = dealt.repartition(*block).sortWithinPartitions(*block)

    def compare(t: pa.Table) -> list[tuple[np.ndarray, ...]]:
        key = np.stack([t[c].to_numpy() for c in block])
        edge = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0), True])
        node, comp, side = t["node"].to_numpy(), t["comp"].to_numpy(), t["own"].to_numpy()
        marks = np.frombuffer(b"".join(x if len(x) == 2 * REGISTERS else x + x for x in t["marks"].to_pylist()), np.uint8).reshape(-1, 2 * REGISTERS)
        of = t["bands"].combine_chunks()
        flat, width = of.flatten().to_numpy(), of.value_lengths().to_numpy()
        at = np.cumsum(width) - width
        # One signature's bands stand for both, so that places agree between documents with one and with two.
        listed = flat[at[:, None] + np.arange(2 * BANDS) % width[:, None]]
        pos = t["pos"].to_numpy()
        held = {}

        def one_set(k: int) -> tuple[np.ndarray, np.ndarray]:
            if k not in held:
                held[k] = _arrays(t["h"][k].as_buffer(), t["w"][k].as_py())
            return held[k]

        out = []
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            c = comp[s:e]
            held.clear()
            found, met = [], np.zeros(e - s, bool)
            if (c == c[0]).all():
                continue
            lo, hi = key[1, s], key[2, s]
            left = np.flatnonzero(side[s:e] == lo)
            right = left if lo == hi else np.flatnonzero(side[s:e] == hi)
            for k in left:
                r = right[right > k] if lo == hi else right
                r = r[c[r] != c[k]]
                r = r[(listed[s:e][r, : pos[s + k]] != listed[s + k, : pos[s + k]]).all(axis=1)]
                agree = (marks[s:e][r] == marks[s + k]).reshape(len(r), 2, REGISTERS).sum(axis=2).max(axis=1)
                r, agree = r[agree >= AGREE * REGISTERS], agree[agree >= AGREE * REGISTERS]
                if exact:
                    close = np.array([max(similarity(*one_set(s + k), *one_set(s + x))) >= ALIKE for x in r], bool)
                    r, agree = r[close], agree[close]
                if len(r):
                    one = np.ones(len(r), np.int64)
                    rows = np.stack([node[s:e][r], one * node[s + k], c[r], one * c[k], agree, one * key[0, s]])
                    if not exact:
                        best = np.lexsort((-agree, c[r]))
                        met[k] = met[r] = True
                        rows = rows[:, best[np.r_[True, c[r][best][1:] != c[r][best][:-1]]]]
                    found.append(rows)
            if not found:
                continue
            rows = np.concatenate(found, axis=1)
            if not exact:
                x, y = np.minimum(rows[2], rows[3]), np.maximum(rows[2], rows[3])
                best = np.lexsort((-rows[4], y, x))
                rows = rows[:, best[np.r_[True, (x[best][1:] != x[best][:-1]) | (y[best][1:] != y[best][:-1])]]]
                m = np.flatnonzero(met)
                out.append((node[s:e][m], None, c[m], None, None, key[0, s:e][m]))
            out.append(tuple(rows))
        return out

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            last = [t[c][-1].as_py() for c in block]
            same = np.logical_and.reduce([t[c].to_numpy() == v for c, v in zip(block, last, strict=True)])
            cut = int(np.argmax(same))  # the last block may go on
            held, t = t.slice(cut).combine_chunks(), t.slice(0, cut)
            for found in compare(t) if t.num_rows else []:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(found[0]), pa.int64()) if x is None else pa.array(x) for x in found], names=["a", "b", "ca", "cb", "agree", "band"])
        for found in compare(held) if held is not None and held.num_rows else []:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(found[0]), pa.int64()) if x is None else pa.array(x) for x in found], names=["a", "b", "ca", "cb", "agree", "band"])

    return dealt.mapInArrow(run, "a long, b long, ca long, cb long, agree long, band long")


def _labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, node, label, class_id) of every row; the label is the least node of its class."""
    signs = written(_signed_docs(docs), "signs")
    each = signs.where("node is not null").select("node", F.posexplode("bands").alias("pos", "band"))
    meet = each.groupBy("band").agg(F.min("node").alias("lead"), F.max("node").alias("top")).where("lead < top").select("band")
    members = written(each.join(meet, "band").groupBy("band", "node").agg(F.min("pos").alias("pos")), "members")
    # What many copies were made from meets more documents than a copy does: it leads, so that most copies link at once.
    sizes = members.groupBy("band").agg(F.count("*").alias("size"))
    members = written(members.join(sizes, "band"), "members")
    reach = members.groupBy("node").agg(F.sum("size").alias("reach"))
    leads = members.join(reach, "node").groupBy("band").agg(F.max(F.struct("reach", "node")).alias("m")).select("band", F.col("m.node").alias("lead"))
    asked = signs.join(reach, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = written(_sets(docs, asked).groupBy("node").agg(F.first("h").alias("h"), F.first("w").alias("w")), "sets")
    pairs = members.join(leads, "band").where("node != lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
    links = written(linked(pairs, sets), "links")
    labels = components(links)
    state = written(members.join(labels, "node", "left").select("band", "size", "pos", "node", F.coalesce("label", "node").alias("comp")), "state")
    mixed = state.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("band")
    marks = signs.where("node is not null").groupBy("node").agg(F.first("marks").alias("marks"), F.first("bands").alias("bands"))
    state = state.join(mixed, "band").join(marks, "node").withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    meets = written(_meetings(state), "meets")
    # Of two components the pair that agrees most goes first: where it is linked, the other pairs have nothing to add.
    best = meets.where("b is not null").groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.max(F.struct("agree", "a", "b")).alias("m")).select("m.a", "m.b")
    more = written(linked(best, sets), "links")
    if more.take(1):
        links = links.union(more)
        labels = components(links)
    # Members with open pairs meet once more in their bands, with sets: members go there, not pairs.
    opened = meets.where("b is null").select("band", F.col("a").alias("node")).distinct()
    opened = written(opened.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("comp")), "opened")
    several = opened.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("band")
    again = opened.join(several, "band").join(marks, "node").join(sets, "node")
    again = again.withColumn("pos", (F.array_position("bands", F.col("band")) - 1).cast("int"))
    again = written(again, "again")
    heavy = again.groupBy("band").agg(F.ceil(F.sum(F.octet_length("h") + F.octet_length("w") + F.octet_length("marks")) / BLOCK).cast("int").alias("chunks"))
    more = written(_meetings(again.join(heavy, "band"), exact=True).select("a", "b"), "links")
    if more.take(1):
        labels = components(links.union(more))
    found = signs.select("doc_id", "node").join(labels, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"))
    least = found.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return found.join(least, "label", "left").select("doc_id", "node", "label", F.coalesce("class_id", "doc_id").alias("class_id"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, class_id) of every row."""
    return _labelled(docs).select("doc_id", "node", "class_id")


def _with_node(docs: DataFrame) -> DataFrame:
    """(_row, _id, _node): each row of `docs` as one value, its doc_id, and the hash of its words as in `_signed_docs`."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), "text")

    def run(batches):
        for batch in batches:
            data, off = column_bytes(batch.column(2))
            for i, j in _parts(off):
                doc, _, _, whole = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
                none = np.bincount(doc, minlength=j - i) == 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(signed(whole), mask=none)], names=["_row", "_id", "_node"])

    return rows.mapInArrow(run, StructType([rows.schema["_row"], rows.schema["_id"]]).add("_node", "long"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each class, the one with the least doc_id; rows without an id stay.

    Where ids occur twice, rows are told apart by id and words: only rows with the same id and words, or with a link, fall together.
    """
    found = written(_labelled(docs), "classes")
    least = found.where("doc_id = class_id")
    if not found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").take(1):
        kept = docs.join(least.select("doc_id"), "doc_id", "left_semi")
        return kept.unionByName(docs.where("doc_id is null"))
    one = least.where("label is not null").groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("m")).select("m.doc_id", "m.node")
    stay = one.union(least.where("label is null").select("doc_id", "node")).distinct().select(F.col("doc_id").alias("_of"), F.col("node").alias("_stay"))
    kept = _with_node(docs).join(stay, (F.col("_id") == F.col("_of")) & F.col("_node").eqNullSafe(F.col("_stay")), "left_semi")
    kept = kept.groupBy("_id", "_node").agg(F.min("_row").alias("_row")).select("_row.*")
    return kept.unionByName(docs.where("doc_id is null"))
