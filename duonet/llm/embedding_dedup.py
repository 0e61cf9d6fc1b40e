r"""Embedding near-duplicates by Euclidean p-stable hashing, with exact cosine checks.

Vectors are normalised; identical ones are one node with a multiplicity. In each of several tables a node's bucket is the
tuple of quantised random projections floor((a . x + b) / w). Two unit vectors with cosine c lie sqrt(2 - 2c) apart, and the
number of projections grows with the logarithm of the number of vectors, the number of tables with the chance that a pair at
the threshold meets, so the expected recall at the threshold stays at RECALL and the candidates for each vector stay few.

Buckets that hold the very same nodes (told by two 64-bit sums of hashes and their number) are compared once, so an isolated
group of near duplicates that meets in every table costs as much as in one.

Inside a bucket the cosines are computed in blocks: a bucket of more than BLOCK nodes is split into runs of at most BLOCK,
and each pair of runs is a task of its own, so no task grows with a bucket. A pair that meets in several tables counts only
in the first (every node carries its bucket numbers of all tables). No pair is ever written: a block emits, for each node,
the links it found, and the edges of a spanning forest of the links inside the block; the sums and the components follow.

Vectors are compared with those of the same length only; every length has projections of its own, drawn from the seed and
the length where they are used.

Defined results: null, empty, zero and non-finite vectors, and vectors that hold a null, link with nothing and are kept.
Repeated rows (equal vectors, also with equal ids) link with each other. A null id takes part; the least non-null id names a
component (null if it has none). An empty table gives no rows. Only the two columns are read. Vectors that are not arrays of
float are compared as doubles. Equal vectors are told by a 128-bit hash of their normalised form.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from duonet.llm._common import cut, join_split, map_rows, mix64, table
from duonet.operators.components import components

THRESHOLD, RECALL, WIDTH, SEED, BLOCK = 0.95, 0.995, 2.0, 20, 512


def meet(distance: float, width: float) -> float:
    """The chance that one quantised projection puts two points so far apart into one cell."""
    if distance <= 0:
        return 1.0
    r = width / distance
    normal = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """Projections for each table and number of tables."""
    near, far = meet(math.sqrt(2 - 2 * threshold), width), meet(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(4 * max(n, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links (a, b) among n nodes."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


_projections: dict[tuple, tuple] = {}


def projections(dim: int, k: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions and shifts of all tables for vectors of this length, and what mixes cells into keys; a few lengths are kept."""
    key = (dim, k, tables, seed)
    if key not in _projections:
        if len(_projections) >= 8:
            _projections.clear()
        rng = np.random.default_rng([seed, dim])
        _projections[key] = rng.normal(size=(dim, k * tables)), rng.uniform(0, WIDTH, k * tables), rng.integers(0, 2**63, (k, tables), dtype=np.uint64) | np.uint64(1)
    return _projections[key]


def normalised(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True)) + 0.0


def by_length(vectors: list[bytes], kind: np.dtype) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
    out = []
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out.append((at, np.frombuffer(b"".join([vectors[i] for i in at]), kind).reshape(len(at), -1)))
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = np.dtype("<f4" if single else "<f8")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    usable = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0), F.lit(False))
    id_kind = rows.schema["id"].dataType

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        from xxhash import xxh3_128_digest

        column = batch.column(1)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
        ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
        raw = [flat[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        sigs: list = [None] * len(raw)
        for at, x in by_length(raw, kind):
            for i, unit in zip(at.tolist(), normalised(x), strict=True):
                sigs[i] = xxh3_128_digest(unit.tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary()), pa.array(raw, pa.binary())], names=["id", "sig", "raw"])

    units = cut(map_rows(rows.where(usable), pack, StructType([StructField("id", id_kind), StructField("sig", BinaryType()), StructField("raw", BinaryType())])))
    nodes = units.groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.min("raw").alias("raw"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))  # numbers of their own, fixed here
    n_nodes, n_units = nodes.agg(F.count("*"), F.sum("copies")).first()
    k, tables = plan(n_nodes, threshold)

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = batch.column(1).to_pylist()
        keys = np.empty((len(raw), tables), np.uint32)
        for at, x in by_length(raw, kind):
            directions, shifts, mixers = projections(x.shape[1], k, tables, seed)
            cells = np.floor((normalised(x) @ directions + shifts) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(x), k, tables)
            keys[at] = mix64((mix64(cells + np.uint64(1)) * mixers).sum(1, dtype=np.uint64)) >> np.uint64(32)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(list(keys.view(np.int32)), pa.list_(pa.int32()))], names=["node", "raw", "copies", "keys"])

    points = cut(map_rows(nodes.select("node", "raw", "copies"), hashed, "node long, raw binary, copies long, keys array<int>"))
    each = points.select("node", F.posexplode("keys").alias("t", "h")).select("node", (F.col("t").cast("long") * (1 << 32) + F.col("h")).alias("key"))
    # of buckets with the same nodes the first table's is enough: it is the first where any two of them meet
    held = each.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).where("n > 1")
    # runs: a bucket of n nodes has ceil(n / BLOCK) of them; a node's run is a hash of it
    sizes = cut(held.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / F.lit(BLOCK)).alias("runs")))
    own = each.join(sizes, "key").withColumn("run", F.pmod(F.xxhash64("node", "key"), F.col("runs")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1), lambda r: F.struct(F.least(r, F.col("run")).alias("i"), F.greatest(r, F.col("run")).alias("j")))
    tasks = own.select("node", "key", "run", F.explode(pairs).alias("p")).select("node", "key", "run", "p.i", "p.j")
    work = tasks.join(points, "node").select("key", "i", "j", "run", "node", "raw", "copies", "keys")
    # several small buckets share a task's group, so that a group is not a handful of rows
    cell = F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(64, sizes.count() // 2000)))
    shape = "node long, links long, other long"

    def check(rows: pa.Table) -> pa.Table:
        size = pc.binary_length(rows.column("raw"))
        rows = rows.append_column("size", size).sort_by([(c, "ascending") for c in ("key", "i", "j", "size", "run", "node")])
        key, i, j, size, run = (rows.column(c).to_numpy() for c in ("key", "i", "j", "size", "run"))
        node, copies, raw = rows.column("node").to_numpy(), rows.column("copies").to_numpy(), rows.column("raw").to_pylist()
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rows), tables)
        differs = lambda x: x[1:] != x[:-1]
        change = np.flatnonzero(np.r_[True, differs(key) | differs(i) | differs(j) | differs(size), True])
        out_node, out_links, out_other = [], [], []
        for lo, hi in zip(change[:-1].tolist(), change[1:].tolist(), strict=True):
            left = np.arange(lo, hi) if i[lo] == j[lo] else lo + np.flatnonzero(run[lo:hi] == i[lo])
            right = left if i[lo] == j[lo] else lo + np.flatnonzero(run[lo:hi] == j[lo])
            if not len(left) or not len(right) or (left is right and len(left) < 2):
                continue
            units = normalised(np.frombuffer(b"".join(raw[lo:hi]), kind).reshape(hi - lo, -1))
            a, b = np.nonzero(units[left - lo] @ units[right - lo].T >= threshold - 1e-9)
            a, b = left[a], right[b]
            once = node[a] != node[b]
            if left is right:
                once &= a < b
            a, b = a[once], b[once]
            exact = np.einsum("ij,ij->i", units[a - lo], units[b - lo]) >= threshold
            a, b = a[exact], b[exact]
            if not len(a):
                continue
            first = np.argmax(keys[a] == keys[b], axis=1)  # the first table where the two meet
            mine = (first << 32) + keys[a, first].astype(np.int64) == key[lo]
            a, b = a[mine], b[mine]
            links = np.bincount(np.r_[a, b] - lo, weights=np.r_[copies[b], copies[a]], minlength=hi - lo).astype(np.int64)
            some = np.flatnonzero(links)
            out_node.append(node[lo + some])
            out_links.append(links[some])
            out_other.append(node[lo + some])
            forest = _spanning(hi - lo, a - lo, b - lo)
            out_node.append(node[[lo + x for x, _ in forest]])
            out_links.append(np.zeros(len(forest), np.int64))
            out_other.append(node[[lo + y for _, y in forest]])
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table([cat(out_node), cat(out_links), cat(out_other)], names=["node", "links", "other"])

    found = cut(work.withColumn("cell", cell).groupBy("cell").applyInArrow(check, shape))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    rooted = nodes.select("node", "sig", "least", "copies").join(links, "node", "left").join(roots, "node", "left")
    named = cut(rooted.select("sig", "least", "copies", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("held"))
    labelled = join_split(named, names, "root", "held", n_nodes or 0).select("sig", "copies", "n_links", "component_id")
    good = join_split(units.select("id", "sig"), cut(labelled), "sig", "copies", n_units or 0).select("id", "n_links", "component_id")
    bad = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.unionByName(bad)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs, so for small tables. Vectors that hold a null, an infinity or NaN, or only zeros, have no norm.
OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])) AS norm FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.norm > 0 AND b.norm > 0 WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

QUERIES = {"op4_embedding_dedup": op4_embedding_dedup}
SQL = {"op4_embedding_dedup": OP4_SQL}
