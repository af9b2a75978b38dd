"""Operator 11: vector codes by k-means over metric trees of an anchors hierarchy.

Vectors are cut into parts. A task packs up to CHUNK vectors into a chunk and builds a
tree of balls over each part of them, middle-out: about sqrt(n) anchors are placed one by
one, each at the point farthest from its anchor and taking the points that are nearer to
it; the anchors' balls are joined in pairs, that of the least radius first, up to a root;
then each anchor's points are a tree of their own. A ball caches count, sums, centre and
radius. Trees are built once and written; a round reads them.

In a round a ball inherits its parent's candidate entries and drops each that another one
beats everywhere in the ball. A ball with one candidate left is wholly owned: its cached
count and sums go to that entry. Leaves that are not compare their points with what
candidates they have, in integers, ties to the lower index. Only sums by part and entry
leave a task, and only the codebooks (parts x entries x width numbers) reach the driver.

Vectors that are null or hold null or NaN or infinite components are dropped. So are
those whose length is not the usual one: of the lengths that the parts divide, the most
frequent, then the longest. Null ids come after all others; among equal ids the lesser
vector comes first. Fewer vectors than entries give a codebook of that many; no vector
gives no row. Repeated rows give repeated results. Components of 2**26/4096 or more in size
are refused with an error, since sums of them need not fit a LONG. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import narrow, written

#: Vectors of a chunk: what a task holds at once.
CHUNK = 4096
#: Points of a ball that is not divided further.
LEAF = 64
#: Integers must be smaller, so that sums over 10**11 vectors fit a LONG.
LARGEST = 1 << 26
#: Share by which a bound is drawn wider than floating point gives it.
_SLACK = 1e-9


def _anchors(x: np.ndarray, k: int) -> list[np.ndarray]:
    """Points of each of at most k anchors; fewer where all points of every anchor are equal to it."""
    far = ((x - x[0]) ** 2).sum(1)
    order = np.argsort(-far, kind="stable")
    owned, reach, pivots = [order], [far[order]], [x[0]]
    while len(owned) < k:
        worst = max(range(len(owned)), key=lambda a: reach[a][0])
        if reach[worst][0] <= 0:
            break
        pivot = x[owned[worst][0]]
        mine, gaps = [], []
        for a in range(len(owned)):
            # points nearer to their anchor than half its distance to the new one cannot move
            gap = ((pivots[a] - pivot) ** 2).sum() / 4
            near = int(np.searchsorted(-reach[a], -gap, "right"))
            if not near:
                continue
            points = owned[a][:near]
            d = ((x[points] - pivot) ** 2).sum(1)
            taken = d < reach[a][:near]
            if taken.any():
                mine.append(points[taken])
                gaps.append(d[taken])
                stay = np.r_[~taken, np.ones(len(owned[a]) - near, bool)]
                owned[a], reach[a] = owned[a][stay], reach[a][stay]
        mine, gaps = np.concatenate(mine), np.concatenate(gaps)
        order = np.argsort(-gaps, kind="stable")
        owned.append(mine[order])
        reach.append(gaps[order])
        pivots.append(pivot)
    return owned


def _joined(centres: np.ndarray, radii: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of nodes to join, in turn: join number k makes node len(centres) + k. The ball of least radius comes first."""
    n = len(centres)
    c, r, w = np.vstack([centres, np.empty((n - 1, centres.shape[1]))]), np.r_[radii, np.empty(n - 1)], np.r_[counts, np.empty(n - 1)]
    cost = np.full((2 * n - 1, 2 * n - 1), np.inf)

    def costs(a: int, others: np.ndarray) -> np.ndarray:
        gap = np.sqrt(((c[others] - c[a]) ** 2).sum(1))
        return np.maximum(np.maximum(r[a], r[others]), (gap + r[a] + r[others]) / 2)

    for a in range(1, n):
        cost[a, :a] = costs(a, np.arange(a))
    alive, out = np.zeros(2 * n - 1, bool), []
    alive[:n] = True
    for new in range(n, 2 * n - 1):
        a, b = divmod(int(cost[:new, :new].argmin()), new)
        out.append((a, b))
        w[new] = w[a] + w[b]
        c[new] = (c[a] * w[a] + c[b] * w[b]) / w[new]
        r[new] = max(np.sqrt(((c[new] - c[a]) ** 2).sum()) + r[a], np.sqrt(((c[new] - c[b]) ** 2).sum()) + r[b])
        alive[[a, b]] = False
        cost[[a, b]], cost[:, [a, b]] = np.inf, np.inf
        others = np.flatnonzero(alive[:new])
        cost[new, others] = costs(new, others)
        alive[new] = True
    return out


class Tree:
    """Balls over integer points. `order` lists points so that each ball's stand together; ball 0 is the root.

    first, last: a ball's range of `order`; left, right: its children, -1 for a leaf; sums, centre, radius: of its points.
    """

    def __init__(self, x: np.ndarray):
        self.nodes: list[list[int]] = []
        self.order = np.empty(len(x), np.int64)
        self.x = x
        if len(x):
            self._grow(np.arange(len(x)), 0)
        self.first, self.last, self.left, self.right = np.array(self.nodes, np.int64).reshape(-1, 4).T
        run = np.vstack([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x[self.order], 0)])
        self.sums = run[self.last] - run[self.first]
        self.measure()

    def measure(self) -> None:
        """Centres and radii from the points, so that they are as tight as can be."""
        count = self.last - self.first
        self.centre = self.sums / np.maximum(count, 1)[:, None]
        # of each level at once: every point meets the balls that hold it
        at = np.repeat(self.first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        ball = np.repeat(np.arange(len(count)), count)
        d = ((self.x[self.order[at]] - self.centre[ball]) ** 2).sum(1)
        self.radius = np.sqrt(np.maximum.reduceat(d, np.cumsum(count) - count)) * (1 + _SLACK) if len(count) else np.empty(0)

    def _grow(self, points: np.ndarray, base: int) -> int:
        """Add the balls over `points`, which stand from `base` on; the number of the topmost."""
        top = len(self.nodes)
        self.nodes.append([base, base + len(points), -1, -1])
        if len(points) <= LEAF:
            self.order[base : base + len(points)] = points
            return top
        x = self.x[points].astype(np.float64)
        parts = _anchors(x, int(np.ceil(np.sqrt(len(points)))))
        if len(parts) == 1:  # all points are equal
            self.order[base : base + len(points)] = points
            return top
        centres = np.array([x[p].mean(0) for p in parts])
        radii = np.array([np.sqrt(((x[p] - c) ** 2).sum(1).max()) for p, c in zip(parts, centres, strict=True)])
        joins = _joined(centres, radii, np.array([len(p) for p in parts], float))
        size = [len(p) for p in parts]
        for a, b in joins:
            size.append(size[a] + size[b])
        todo = [(len(size) - 1, top, base)]  # from the root down, so that places are known
        while todo:
            node, ball, at = todo.pop()
            children = []
            for child, begin in zip(joins[node - len(parts)], (at, at + size[joins[node - len(parts)][0]]), strict=True):
                if child < len(parts):
                    children.append(self._grow(points[parts[child]], begin))
                else:
                    children.append(len(self.nodes))
                    self.nodes.append([begin, begin + size[child], -1, -1])
                    todo.append((child, children[-1], begin))
            self.nodes[ball][2:] = children
        return top

    def owners(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(balls wholly owned, their entries, points of other leaves, their entries) under a codebook of integer rows."""
        entries = len(book)
        wide = book.astype(np.float64)
        apart = np.sqrt(((wide[:, None] - wide[None]) ** 2).sum(2))
        ball, may = np.zeros(min(1, len(self.first)), np.int64), np.ones((min(1, len(self.first)), entries), bool)
        owned, owner, points, nearest = [], [], [], []
        while len(ball):
            d = ((self.centre[ball][:, None] - wide[None]) ** 2).sum(2)
            d[~may] = np.inf
            best = d.argmin(1)
            lead = d - d[np.arange(len(ball)), best][:, None]
            # |x-c|^2 - |x-best|^2 is linear in x, so in the ball it is at least lead - 2 |c-best| radius
            most = np.where(may, d, 0).max(1)
            may &= lead <= 2 * apart[best] * self.radius[ball][:, None] * (1 + _SLACK) + _SLACK * (1 + most[:, None])
            sole = may.sum(1) == 1
            owned.append(ball[sole])
            owner.append(best[sole])
            ball, may = ball[~sole], may[~sole]
            leaf = self.left[ball] < 0
            n = (self.last - self.first)[ball[leaf]]
            at = np.repeat(self.first[ball[leaf]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            mask = np.repeat(may[leaf], n, 0)
            own = self.order[at]
            far = ((self.x[own][:, None].astype(np.int64) - book[None]) ** 2).sum(2)
            far[~mask] = np.iinfo(np.int64).max
            points.append(own)
            nearest.append(far.argmin(1))
            below = ball[~leaf]
            ball, may = np.r_[self.left[below], self.right[below]], np.vstack([may[~leaf]] * 2)
        whole = lambda x: np.concatenate([np.empty(0, np.int64), *x])
        return whole(owned), whole(owner), whole(points), whole(nearest)

    def gathered(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, sums) of the points nearest to each entry."""
        owned, owner, points, nearest = self.owners(book)
        count, total = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
        np.add.at(count, owner, (self.last - self.first)[owned])
        np.add.at(total, owner, self.sums[owned])
        np.add.at(count, nearest, 1)
        np.add.at(total, nearest, self.x[points].astype(np.int64))
        return count, total

    def assigned(self, book: np.ndarray) -> np.ndarray:
        """The entry of every point."""
        owned, owner, points, nearest = self.owners(book)
        out = np.empty(len(self.x), np.int64)
        n = (self.last - self.first)[owned]
        at = np.repeat(self.first[owned] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        out[self.order[at]] = np.repeat(owner, n)
        out[points] = nearest
        return out

    def packed(self) -> bytes:
        """What cannot be had cheaply from the points: order, balls and sums."""
        return b"".join(a.astype(kind).tobytes() for a, kind in ((self.order, "<i4"), (self.first, "<i4"), (self.last, "<i4"), (self.left, "<i4"), (self.right, "<i4"), (self.radius, "<f8"), (self.sums, "<i8")))

    @classmethod
    def unpacked(cls, raw: bytes, x: np.ndarray, balls: int) -> Tree:
        self, at = cls.__new__(cls), 0
        self.x = x
        for name, n, kind in (("order", len(x), "<i4"), *((k, balls, "<i4") for k in ("first", "last", "left", "right")), ("radius", balls, "<f8"), ("sums", balls * x.shape[1], "<i8")):
            found = np.frombuffer(raw, kind, n, at)
            at += found.nbytes
            setattr(self, name, found.astype(np.int64) if kind != "<f8" else found)
        self.sums = self.sums.reshape(balls, x.shape[1])
        self.centre = self.sums / np.maximum(self.last - self.first, 1)[:, None]
        return self


def _valid(vectors: DataFrame, vec_col: str) -> DataFrame:
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vec_col).isNotNull() & ~bad)


def kept(vectors: DataFrame, parts: int, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 4096) -> DataFrame:
    """(id, label, ints) of the vectors that are coded: floor(scale * component) as integers."""
    good = _valid(vectors, vec_col).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    sizes = good.groupBy(F.size("v").alias("n")).count().where((F.col("n") > 0) & (F.col("n") % parts == 0))
    usual = sizes.orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    n = usual[0]["n"] if usual else -1
    whole = F.transform("v", lambda x: F.when(F.abs(F.floor(x.cast("double") * scale)) < LARGEST, F.floor(x.cast("double") * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large"))))
    return good.where(F.size("v") == n).select("id", "label", whole.alias("ints"))


def chunks(rows: DataFrame, parts: int) -> DataFrame:
    """A row for each chunk: ids, labels, its integers by part, and a packed tree for each part."""
    names = ["ids", "labels", "points", "trees", "balls"]
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, labels = (pa.concat_arrays([b.column(k) for b in batches]) for k in (0, 1))
        x = np.concatenate([b.column(2).flatten().to_numpy(zero_copy_only=False) for b in batches]).reshape(len(ids), parts, -1).transpose(1, 0, 2)
        trees = [Tree(np.ascontiguousarray(part)) for part in x]
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        return pa.RecordBatch.from_arrays([one(ids), one(labels), pa.array([x.astype("<i4").tobytes()], pa.binary()), pa.array([[t.packed() for t in trees]], pa.list_(pa.binary())), pa.array([[len(t.first) for t in trees]], pa.list_(pa.int32()))], names=names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                own = batch.slice(0, CHUNK - n)
                held.append(own)
                n, batch = n + own.num_rows, batch.slice(own.num_rows)
                if n == CHUNK:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return rows.mapInArrow(run, f"ids array<{id_kind}>, labels array<{label_kind}>, points binary, trees array<binary>, balls array<int>")


def _trees(batch: pa.RecordBatch, parts: int):
    """(chunk's place in the batch, its trees)."""
    for k, (raw, trees, balls) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("points", "trees", "balls")), strict=True)):
        n = len(batch.column("ids")[k])
        x = np.frombuffer(raw, "<i4").reshape(parts, n, -1).astype(np.int64)
        yield k, [Tree.unpacked(t, p, b) for t, p, b in zip(trees, x, balls, strict=True)]


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """parts x entries x width: the parts of the vectors with the smallest ids."""
    found = rows.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    return np.array([r["ints"] for r in found], np.int64).reshape(len(found), parts, -1).transpose(1, 0, 2) if found else np.empty((parts, 0, 0), np.int64)


def refined(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after a round: the floor of the mean of an entry's points; entries without points stay."""
    parts, entries, width = books.shape

    def run(batches):
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for _, own in _trees(batch, parts):
                for p, tree in enumerate(own):
                    c, t = tree.gathered(books[p])
                    count[p] += c
                    total[p] += t
        at = np.indices((parts, entries, width + 1), np.int32).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in at] + [pa.array(np.concatenate([total, count[:, :, None]], 2).ravel())], names=["part", "entry", "k", "n"])

    summed = trees.mapInArrow(run, "part int, entry int, k int, n long").groupBy("part", "entry", "k").agg(F.sum("n").alias("n"))
    out = np.zeros((parts, entries, width + 1), np.int64)
    for r in summed.collect():  # parts * entries * (width + 1) rows
        out[r["part"], r["entry"], r["k"]] = r["n"]
    used = out[:, :, -1] > 0
    books = books.copy()
    books[used] = out[:, :, :-1][used] // out[:, :, -1][used][:, None]
    return books


def trained(rows: DataFrame, trees: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = refined(trees, books)
    return books


def codes(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of every vector: two hex digits for each part, and the squared distance to what they stand for."""
    parts = len(books)
    digits = np.array(["%02x" % e for e in range(256)])
    if books.shape[1] > 256:
        raise ValueError("two hex digits tell 256 entries apart")
    id_kind, label_kind = (trees.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))

    def run(batches):
        for batch in batches:
            for k, own in _trees(batch, parts):
                entry = [t.assigned(b) for t, b in zip(own, books, strict=True)]
                error = sum(((t.x - b[e]) ** 2).sum(1) for t, b, e in zip(own, books, entry, strict=True))
                code = pd.Series(digits[entry[0]])
                for e in entry[1:]:
                    code = code + digits[e]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, batch.column("labels")[k].values, pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])

    return trees.mapInArrow(run, f"id {id_kind}, label {label_kind}, code string, error long")


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every vector that is kept; label_error is the error over all of its label."""
    rows = kept(vectors, parts, id_col, vec_col, label_col)
    trees = written(chunks(rows, parts), "trees")
    books = trained(rows, trees, parts, entries, rounds)
    found = written(codes(trees, books), "codes")
    sums = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = found.join(narrow(sums, "errors"), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same codes by comparing every part with every entry."""
    out = f"""WITH ok AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid, vec_id, label, v FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
x AS (SELECT rid, (k - 1) // (len(v) // {parts}) AS part, (k - 1) % (len(v) // {parts}) AS pos, v[k] AS x FROM ok, (SELECT unnest(range(1, 4097)) AS k) WHERE k <= len(v)),
b0 AS (SELECT part, CAST(rid - 1 AS INTEGER) AS entry, pos, x AS c FROM x WHERE rid <= {entries})"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS MATERIALIZED (SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT rid, part, entry, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN b{r} USING (part, pos) GROUP BY rid, part, entry) GROUP BY rid, part)"""
        if r < rounds:
            out += f""",
b{r + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m, c) AS c FROM b{r} LEFT JOIN (
  SELECT part, entry, pos, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM x JOIN a{r} USING (rid, part) GROUP BY part, entry, pos) USING (part, entry, pos))"""
    return (
        out
        + f""",
found AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256 FROM found JOIN ok USING (rid)"""
    )


#: SQL for `coded` with its defaults, over vectors of one length.
ORACLE = _sql()
