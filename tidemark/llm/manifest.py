"""Operator 12: a Merkle manifest of a dataset in blocks of van Emde Boas layout.

Every row is a leaf; the leaves of a group (a source) stand in order, and every FAN
nodes in turn become one, level by level, up to the group's root. The roots of all
groups are the leaves of one more tree, whose root stands for the dataset.

A tree is stored as blocks: aligned subtrees of EDGES levels of edges, each a row with
the digests of its nodes. Within a block nodes stand in van Emde Boas order: the levels
are split at half their number, the upper half comes first as a tree of its own, then
the trees that hang below it, each laid out in the same way. A block's root is a leaf of
the blocks of the next layer, which are made in the same way until each group has one
block. `places` is the arithmetic of that order; construction writes and retrieval
reads siblings by it, whatever the sizes of pages and caches. The last nodes of a level may be missing; the
order has no holes for them.

Proofs come from the stored blocks, from the top layer down: a block hands the runs of
siblings that it met, and those from above, to each of its leaves. Only digests are
shuffled, never texts, and at most FAN**EDGES rows meet in one task.

A null id or source is a value of its own: a null source comes first, then by UTF-8 bytes; a null id comes
first and is never tampered with; equal ids stand in order of their leaves, so that repeated rows get
equal rows. An empty table has no root and gives no row. Texts are hashed whole, of any length. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType
from pyspark.sql.window import Window

from tidemark.llm.shared import narrow, written

#: Nodes of a run, and levels of edges of a block: at most 256 leaves.
FAN, EDGES = 16, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def width(leaves: int, levels: int, depth: int) -> int:
    """Nodes at `depth` of a tree of `levels` levels of nodes."""
    return -(-leaves // FAN ** (levels - 1 - depth))


def places(leaves: int, levels: int, depth: int, i: np.ndarray) -> np.ndarray:
    """Addresses of nodes i at `depth` of a tree with so many leaves in van Emde Boas order."""
    if levels == 1:
        return np.zeros(len(i), np.int64)
    upper = levels // 2
    lower = levels - upper
    if depth < upper:
        return places(width(leaves, levels, upper - 1), upper, depth, i)
    each = FAN ** (depth - upper)  # nodes of this level in a lower tree
    tree, own = i // each, i % each
    full = FAN ** (lower - 1)  # leaves of a lower tree but the last
    at = sum(width(leaves, levels, d) for d in range(upper)) + tree * sum(FAN**d for d in range(lower))
    last = width(leaves, levels, upper) - 1
    part = tree == last
    out = np.empty(len(i), np.int64)
    out[~part] = at[~part] + places(full, lower, depth - upper, own[~part])
    out[part] = at[part] + places(leaves - last * full, lower, depth - upper, own[part])
    return out


@lru_cache(maxsize=4096)
def layout(leaves: int, levels: int) -> tuple[np.ndarray, ...]:
    """Addresses of the nodes of each depth, the root's first."""
    return tuple(places(leaves, levels, d, np.arange(width(leaves, levels, d))) for d in range(levels))


def run_hash(nodes: list[bytes]) -> bytes:
    """The parent of a run: SHA-256 of its digests as hex text."""
    return hashlib.sha256(b"".join(nodes).hex().encode()).digest()


def built(leaves: list[bytes], levels: int) -> list[bytes]:
    """The nodes of a block in van Emde Boas order, of which the first is its root."""
    at = layout(len(leaves), levels)
    out = [b""] * sum(map(len, at))
    for d in reversed(range(levels)):
        for i, p in enumerate(at[d].tolist()):
            out[p] = leaves[i]
        leaves = [run_hash(leaves[i : i + FAN]) for i in range(0, len(leaves), FAN)]
    return out


def runs(nodes: bytes, leaves: int, levels: int) -> list[list[bytes]]:
    """For each level from the leaves up to below the root, its runs as digests in turn, found by their addresses."""
    out = []
    for d in reversed(range(1, levels)):
        at = layout(leaves, levels)[d]
        out.append([b"".join(nodes[32 * p : 32 * p + 32] for p in at[i : i + FAN].tolist()) for i in range(0, len(at), FAN)])
    return out


def depth_of(n: Column) -> Column:
    """Levels of edges over n leaves: until one node is left."""
    out = F.lit(0)
    for k in range(15):
        out = F.when(n > F.lit(FAN**k), F.lit(k + 1)).otherwise(out)
    return out


def ranked(leaves: DataFrame, order: list[str], name: str) -> DataFrame:
    """`leaves` (group, salt, ...) with `pos` from 0 in its group by `order` and `n` of its group: sorted ranges, then sums of ranges."""
    spark = leaves.sparkSession
    fields = leaves.columns
    dealt = leaves.repartitionByRange(*[F.col(c) for c in ("group", *order, "salt")]).sortWithinPartitions("group", *order, "salt")
    at = fields.index("group")

    def count(batches):
        group, k = object(), 0
        for batch in batches:
            own = []
            for g in batch.column(at).to_pylist():
                k = k + 1 if g == group else 0
                group = g
                own.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*fields, "k"])

    dealt = dealt.mapInArrow(count, StructType([*leaves.schema.fields]).add("k", LongType())).withColumn("part", F.spark_partition_id())
    dealt = written(dealt, name)
    sums = dealt.groupBy("group", "part").agg(F.count("*").alias("c"))  # a row for each range and group that meet: a group's ranges stand together
    past = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"before": F.coalesce(F.sum("c").over(past), F.lit(0)), "n": F.sum("c").over(Window.partitionBy("group"))}).drop("c")
    return dealt.join(narrow(sums, f"{name}-sums"), ["group", "part"]).withColumn("pos", F.col("before") + F.col("k")).drop("k", "part", "before", "salt")


def blocks(leaves: DataFrame, layer: int) -> DataFrame:
    """(group, block, n, leaves, levels, nodes, rows) of a layer from (group, n, pos, digest, row): a row for each aligned subtree."""
    size = FAN**EDGES
    edges = F.least(F.lit(EDGES), F.greatest(F.lit(0), depth_of(F.col("n")) - EDGES * layer))
    found = leaves.groupBy("group", F.floor(F.col("pos") / size).cast("long").alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest", "row"))).alias("leaf"))
    found = found.select("group", "block", "n", edges.alias("edges"), F.col("leaf.digest").alias("digests"), F.col("leaf.row").alias("rows"))

    def run(batches):
        for batch in batches:
            digests, edges = batch.column("digests").to_pylist(), batch.column("edges").to_pylist()
            nodes = [b"".join(built(d, e + 1)) for d, e in zip(digests, edges, strict=True)]
            sizes, levels = [len(d) for d in digests], [e + 1 for e in edges]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("group", "block", "n")), pa.array(sizes, pa.int32()), pa.array(levels, pa.int32()), pa.array(nodes, pa.binary()), batch.column("rows")], names=["group", "block", "n", "leaves", "levels", "nodes", "rows"])

    kind = found.schema["rows"].dataType.simpleString()
    return found.mapInArrow(run, f"group string, block long, n long, leaves int, levels int, nodes binary, rows {kind}")


def layers(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The written blocks of all layers of the trees over `leaves` (group, n, pos, digest, row)."""
    out = [written(blocks(leaves, 0), f"{name}-0")]
    while out[-1].where("block > 0").limit(1).count():  # a block is FAN**EDGES leaves, so there are few layers
        roots = out[-1].select("group", "n", F.col("block").alias("pos"), F.substring("nodes", 1, 32).alias("digest"), F.struct("block").alias("row"))
        out.append(written(blocks(roots, len(out)), f"{name}-{len(out)}"))
    return out


_STEPS = "array<struct<i:int,run:binary>>"
_ARROW_STEPS = pa.list_(pa.struct([("i", pa.int32()), ("run", pa.binary())]))


def _own_steps(i: int, levels: list[list[bytes]]) -> list[tuple[int, bytes]]:
    """(place in its run, run) of leaf i on each level of its block."""
    return [(i // FAN**d % FAN, r[i // FAN ** (d + 1)]) for d, r in enumerate(levels)]


def _handed(layer: DataFrame, above: DataFrame) -> DataFrame:
    """`above` for the blocks below those of `layer`."""
    joined = layer.join(above, ["group", "block"]).select("group", "block", "subroot", "root", "leaves", "levels", "nodes", "path")

    def run(batches):
        for batch in batches:
            for k, (block, n, levels, nodes, path) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "leaves", "levels", "nodes", "path")), strict=True)):
                up = runs(nodes, n, levels)
                own = [[{"i": a, "run": x} for a, x in _own_steps(i, up)] + path for i in range(n)]
                same = [pa.array([batch.column(c)[k].as_py()] * n, t) for c, t in (("group", pa.string()), ("subroot", pa.binary()), ("root", pa.binary()))]
                yield pa.RecordBatch.from_arrays([same[0], pa.array(np.arange(n) + block * FAN**EDGES), *same[1:], pa.array(own, _ARROW_STEPS)], names=["group", "block", "subroot", "root", "path"])

    return joined.mapInArrow(run, f"group string, block long, subroot binary, root binary, path {_STEPS}")


def paths(stored: list[DataFrame], tops: DataFrame, name: str) -> DataFrame:
    """(group, block, subroot, root, path) for the blocks of the lowest layer, from (group, subroot, root, path) of the groups' roots.

    path: for each level from a block's root up, its place in its run and the run.
    """
    above = tops.withColumn("block", F.lit(0).cast("long"))
    for k in reversed(range(1, len(stored))):
        above = written(_handed(stored[k], above), f"{name}-paths-{k}")
    return above


def folded(digest: bytes, path: list[tuple[int, bytes]]) -> bytes:
    """The root over a leaf and its siblings."""
    for i, run in path:
        digest = hashlib.sha256((run[: 32 * i] + digest + run[32 * i + 32 :]).hex().encode()).digest()
    return digest


def leaf(fields: dict[str, Column]) -> Column:
    """SHA-256 over `-` or length, colon and value of each field."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*(one(c) for c in fields.values())), 256))


def lowered(text: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", every: int = 5) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, digests as hex text."""
    own = {c: F.col(c) for c in fields}
    twisted = own | {text_col: lowered(F.col(text_col))}
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    group = F.coalesce(F.concat(F.lit("s"), F.col(group_col)), F.lit(""))  # a null comes first
    base = docs.select(group.alias("group"), F.col(id_col).alias("id"), leaf(own).alias("digest"), F.when(hit, leaf(twisted)).alias("bad"), F.monotonically_increasing_id().alias("salt"))
    base = written(base, "leaves")
    placed = ranked(base, ["id", "digest"], "dealt").select("group", "n", "pos", "digest", F.struct("id", "bad").alias("row"))
    stored = layers(placed, "blocks")
    # the groups' roots are the leaves of one more tree
    roots = stored[-1].where("block = 0").select(F.lit("").alias("group"), F.col("group").alias("of"), F.substring("nodes", 1, 32).alias("digest"), F.lit(0).cast("long").alias("salt"))
    top = layers(ranked(roots, ["of"], "groups").select("group", "n", "pos", "digest", F.struct("of").alias("row")), "top")
    root = F.substring("nodes", 1, 32)
    whole = top[-1].select("group", root.alias("subroot"), root.alias("root"), F.array().cast(_STEPS).alias("path"))
    return _proofs(stored[0], paths(stored, _roots(top[0], paths(top, whole, "top")), "docs"), id_col)


def _roots(lowest: DataFrame, above: DataFrame) -> DataFrame:
    """(group, subroot, root, path) of every group from the lowest blocks of the tree over groups."""
    joined = lowest.join(above, ["group", "block"]).select("leaves", "levels", "nodes", "rows", "path", "root")

    def run(batches):
        for batch in batches:
            for n, levels, nodes, rows, path, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                up, at = runs(nodes, n, levels), layout(n, levels)[-1].tolist()
                own = [[{"i": a, "run": x} for a, x in _own_steps(i, up)] + path for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([r["of"] for r in rows], pa.string()), pa.array([nodes[32 * p : 32 * p + 32] for p in at], pa.binary()), pa.array([root] * n, pa.binary()), pa.array(own, _ARROW_STEPS)], names=["group", "subroot", "root", "path"])

    return written(joined.mapInArrow(run, f"group string, subroot binary, root binary, path {_STEPS}"), "roots")


def _proofs(lowest: DataFrame, above: DataFrame, id_col: str) -> DataFrame:
    """Every row with what its proof says, from the lowest blocks and the paths above them."""
    joined = lowest.join(above, ["group", "block"]).select("leaves", "levels", "nodes", "rows", "path", "subroot", "root")
    kind = joined.schema["rows"].dataType.elementType["id"].dataType.simpleString()
    names = [id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches):
        for batch in batches:
            keys = batch.column("rows")
            for k, (n, levels, nodes, rows, path, subroot, root) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                up, at = runs(nodes, n, levels), layout(n, levels)[-1].tolist()
                higher = [(p["i"], p["run"]) for p in path]
                tail = b"".join(r[: 32 * i] + r[32 * i + 32 :] for i, r in higher).hex().encode()
                out = []
                for i, (row, p) in enumerate(zip(rows, at, strict=True)):
                    own = _own_steps(i, up)
                    proof = hashlib.sha256(b"".join(r[: 32 * j] + r[32 * j + 32 :] for j, r in own).hex().encode() + tail).hexdigest()
                    digest = nodes[32 * p : 32 * p + 32]
                    back = folded(digest if row["bad"] is None else row["bad"], own + higher)
                    out.append((digest.hex(), subroot.hex(), root.hex(), proof, back.hex(), back == root))
                ids = keys[k].values.field("id")
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.bool_() if names[j + 1] == "verified" else pa.string()) for j, c in enumerate(zip(*out, strict=True)))], names=names)

    return joined.mapInArrow(run, f"{id_col} {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _sql(levels: int = 6, tops: int = 4) -> str:
    """The same proofs by grouping runs level by level; so many levels hold 16**levels rows a source."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    hashed = lambda text: f"sha256({field('doc_id')} || {field('source')} || {field('lang')} || {field('n_chars')} || {text})"
    bits = "list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(substr(k, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0])))"
    crc = f"list_reduce({bits}, lambda c, b: CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END)"
    out = f"""WITH keyed AS (SELECT doc_id, source, {hashed(field("text"))} AS leaf, CAST(doc_id AS VARCHAR) AS k,
  {hashed(field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))} AS low FROM documents),
d AS (SELECT doc_id, coalesce('s' || source, '') AS g, leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN low ELSE leaf END AS given FROM keyed),
p0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
n0 AS (SELECT g, pos, leaf AS h FROM p0)"""
    for k in range(levels):
        out += f""",
r{k} AS MATERIALIZED (SELECT g, pos // 16 AS up, list(h ORDER BY pos) AS run, (count(*) OVER (PARTITION BY g)) = 1 AND count(*) = 1 AS done FROM n{k} GROUP BY g, pos // 16),
n{k + 1} AS (SELECT g, up AS pos, CASE WHEN done THEN run[1] ELSE sha256(list_aggregate(run, 'string_agg', '')) END AS h FROM r{k})"""
    out += f""",
t0 AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos FROM n{levels})"""
    for k in range(tops):
        out += f""",
u{k} AS MATERIALIZED (SELECT pos // 16 AS up, list(h ORDER BY pos) AS run, (count(*) OVER ()) = 1 AND count(*) = 1 AS done FROM t{k} GROUP BY pos // 16),
t{k + 1} AS (SELECT up AS pos, CASE WHEN done THEN run[1] ELSE sha256(list_aggregate(run, 'string_agg', '')) END AS h FROM u{k})"""
    out += ",\nf0 AS (SELECT p0.*, t0.h AS subroot, t0.pos AS tpos, (SELECT h FROM t{0}) AS root, '' AS proof, given AS cur FROM p0 JOIN t0 USING (g))".format(tops)
    for k in range(levels + tops):
        table, at, on = (f"r{k}", "pos", f"r.g = f.g AND r.up = f.pos // {16 ** (k + 1)}") if k < levels else (f"u{k - levels}", "tpos", f"r.up = f.tpos // {16 ** (k - levels + 1)}")
        place = f"(f.{at} // {16 ** (k if k < levels else k - levels)}) % 16"
        text = lambda part: f"coalesce(list_aggregate({part}, 'string_agg', ''), '')"
        left, right = text(f"run[1:{place}]"), text(f"run[{place} + 2:]")
        out += f""",
f{k + 1} AS (SELECT f.* EXCLUDE (proof, cur), CASE WHEN done THEN proof ELSE proof || {left} || {right} END AS proof,
  CASE WHEN done THEN cur ELSE sha256({left} || cur || {right}) END AS cur FROM f{k} f JOIN {table} r ON {on})"""
    return out + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM f{levels + tops}"


ORACLE = _sql()
