r"""N-gram Jaccard self-join by parity sketches.

A document is the set of its distinct n-word shingles (64-bit hashes). Two documents link when
``100 * intersection >= percent * union``; then their symmetric difference is at most D, which follows from their sizes.

Sketch: per size band the hash space splits into B = D + 1 + e blocks of 64 parity bits each, and every shingle is XOR-hashed
into its block: it flips the bits of its mixed hash there, about half of the 64. The Hamming distance of two sketches, counted
in blocks, is at most their symmetric difference: a shingle that both sets hold flips the same bits in both, so blocks can
differ only where a shingle of just one set falls, and each of those at most |A xor B| shingles falls into one block. (Plain
bits are the same sketch with blocks of one bit, whose distance bounds in the same way but is cut into segments that
one-bit agreement by chance makes far less telling; segments of 64 bits are what the pigeonhole join needs as keys.) So
linked documents, whose symmetric difference is at most D, agree in at least B - D = 1 + e segments. Bands follow
``r = floor(100 * l / percent)``, so a document meets its partners in its own band or the next and takes part in both.

Pigeonhole join: a document may leave out its e most frequent blocks, for any order of blocks that all documents share: of
1 + e blocks that two documents agree in, the rarest is among the e most frequent of neither. So the blocks that are empty
or hold only boilerplate shingles, which would pair everything, cost nothing and no pair is lost. Block frequencies are
counted in Spark, pre-aggregated by bounded chunks and packed by buckets of the hash space; only blocks that at least two
distinct sets hold go on.

Candidates and verification: identical sets are one node, and of blocks with the same nodes one is enough. In a round, every
block that still holds nodes of different components picks one of them, and pairs of it with the others (of other
components) are verified exactly on whole shingle sets; links update the components. Copies of one another thus fall
together without all pairs of a group. After STAR_ROUNDS rounds the pairs that are left between components are all compared
inside tasks by a second sketch, one bit for each shingle's place, flipped by each shingle there: its Hamming distance is at
most the symmetric difference, so pairs beyond D go without being written; the others are verified exactly. Blocks of more
than BLOCK nodes are compared in runs of at most about BLOCK, each pair of runs by itself.

Links: two linked sets are always in one component, so all links are found by comparing each component's whole sets with one
another, exactly. Components of more than RUN nodes or RUN_BYTES of hashes are compared in runs of about that, each pair of
runs by itself. No pair is written: a task emits how many rows each node links with there, and the sums follow.

Defined results: A-Z is lower-cased; a text with fewer words than n is one shingle of them all; a null, empty or blank text
has no shingles and links with nothing. Rows with an equal id are texts of their own and take the least id of their
component; a null id takes part and names nothing. Every input row gives one row; an empty table gives none. Only the id and
text columns are read, so other columns can have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from duonet.llm._chunks import pack_numbers, unpack_numbers
from duonet.llm._common import GOLDEN, buckets_for, cut, extended, join_salted, join_split, map_rows, mix64, plain, small, table, texts_of, word_hashes
from duonet.llm.substring_dedup import _pack, _unpack
from duonet.operators.components import components

STAR_ROUNDS, BLOCK, BITS_EACH = 2, 512, 32
#: Shared blocks for each partition of the tables that follow from them.
ROWS_EACH = 20_000
CHUNK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Nodes and bytes of hashes in a run of a component, and shingles that are counted at once.
RUN, RUN_BYTES, COLUMNS = 1024, 8 << 20, 4096


def shingles(text: bytes, n: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(n, len(words))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = mix64(out * GOLDEN + h[k : len(h) - n + 1 + k])
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def bands(percent: int, size: int) -> tuple[int, int]:
    """The band that a set of this size falls into, and the next one's largest size is found by largest()."""
    low, band = 1, 0
    while True:
        high = 100 * low // percent
        if size <= high:
            return band, high
        low, band = high + 1, band + 1


def blocks_of(high: int, percent: int) -> tuple[int, int]:
    """(blocks, e) of a band with this largest size; no blocks where only equal sets can link."""
    d = 2 * high * (100 - percent) // (100 + percent)
    if not d:
        return 0, 0
    e = 1 + (d + 1) // 8
    return d + 1 + e, e


def instances(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(band, blocks, e) of the two bands a set takes part in."""
    band, high = bands(percent, size)
    return [(band, *blocks_of(high, percent)), (band + 1, *blocks_of(100 * (high + 1) // percent, percent))]


def block_keys(hashes: np.ndarray, band: int, blocks: int) -> np.ndarray:
    """The keys of all blocks: their parity, mixed with band and place."""
    which = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)  # ascending as the hashes are
    total = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(mix64(hashes))])
    bounds = np.searchsorted(which, np.arange(blocks + 1, dtype=np.uint64))
    parity = total[bounds[1:]] ^ total[bounds[:-1]]
    return mix64(parity + mix64(np.arange(blocks, dtype=np.uint64) + np.uint64(band << 32)))


def signatures(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """id, size and sig (of the whole set; null if empty) of every row."""
    from xxhash import xxh3_128_digest

    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, n) for t in texts_of(batch.column(1))]
        sigs = [xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())], names=["id", "size", "sig"])

    return map_rows(docs.select(id_col, text_col), run, f"id {id_type}, size long, sig binary")


def sketch(docs: DataFrame, text_col: str, n: int, percent: int) -> DataFrame:
    """sig, size and block keys of the sets; a task gives each of its sets once, so a hot set is a row for each task."""
    from xxhash import xxh3_128_digest

    def run(batches):
        seen: set[bytes] = set()
        cache: dict[int, list] = {}
        for batch in batches:
            sizes, sigs, keys = [], [], []
            for text in texts_of(batch.column(0)):
                hashes = shingles(text, n)
                size = len(hashes)
                sig = xxh3_128_digest(hashes.tobytes())
                if size not in cache:
                    cache[size] = [x for x in instances(size, percent) if x[1]] if size else []
                if cache[size] and sig not in seen:
                    seen.add(sig)
                    sizes.append(size)
                    sigs.append(sig)
                    keys.append(b"".join(block_keys(hashes, band, blocks).tobytes() for band, blocks, _ in cache[size]))
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], names=["sig", "size", "keys"])

    return docs.select(text_col).mapInArrow(run, "sig binary, size long, keys binary")


def shared_blocks(keyed: DataFrame, shingle_count: int, percent: int) -> DataFrame:
    """(key, sig, size): the blocks that a set keeps and at least one other set has. shingle_count: of all rows together."""
    total = shingle_count * 8 * 5 * (100 - percent) / (100 + percent)  # about the bytes of all keys
    n_chunks, n_buckets = 1 + int(total) // CHUNK_BYTES, buckets_for(total, BUCKET_BYTES, 256)
    shift = 64 - (n_buckets.bit_length() - 1)
    dealt = keyed.select(F.pmod(F.xxhash64("sig"), F.lit(n_chunks)).cast("long").alias("chunk"), "sig", "size", "keys")

    def distinct_sets(rows: pa.Table) -> dict[bytes, tuple[int, np.ndarray]]:
        return {s: (k, np.frombuffer(b, "<u8")) for s, k, b in zip(rows.column("sig").to_pylist(), rows.column("size").to_pylist(), rows.column("keys").to_pylist(), strict=True)}

    def send(rows: pa.Table) -> pa.Table:
        sets = distinct_sets(rows)
        hashes, counts = np.unique(np.concatenate([k for _, k in sets.values()]), return_counts=True)
        bounds = np.searchsorted(hashes >> np.uint64(shift), np.arange(n_buckets + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(bounds)).tolist()
        spans = [(bounds[b], bounds[b + 1]) for b in some]
        chunk = rows.column("chunk")[0].as_py()
        return pa.table({"bucket": pa.array(some, pa.int64()), "chunk": pa.array([chunk] * len(some), pa.int64()), "hashes": pa.array([_pack(hashes[a:b]) for a, b in spans], pa.binary()), "counts": pa.array([pack_numbers(counts[a:b]) for a, b in spans], pa.binary())})

    def count(rows: pa.Table) -> pa.Table:
        top = rows.column("bucket")[0].as_py() >> (64 - shift - 8)
        own = [_unpack(b, top) for b in rows.column("hashes").to_pylist()]
        counts = [unpack_numbers(b, len(h)) for b, h in zip(rows.column("counts").to_pylist(), own, strict=True)]
        every, place = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(place, weights=np.concatenate(counts)).astype(np.int64)
        out = {"chunk": [], "hashes": [], "counts": []}
        for chunk, h in zip(rows.column("chunk").to_pylist(), own, strict=True):
            found = total[np.searchsorted(every, h)]
            if (twice := found > 1).any():
                out["chunk"].append(chunk)
                out["hashes"].append(h[twice].tobytes())
                out["counts"].append(found[twice].tobytes())
        return pa.table(out, schema=pa.schema([("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())]))

    def keep(rows: pa.Table, answers: pa.Table) -> pa.Table:
        hashes = np.frombuffer(b"".join(answers.column("hashes").to_pylist()), "<u8")
        counts = np.frombuffer(b"".join(answers.column("counts").to_pylist()), "<i8")
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        out_key, out_sig, out_size = [], [], []
        if len(hashes):
            for sig, (size, keys) in distinct_sets(rows).items():
                at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
                seen = np.where(hashes[at] == keys, counts[at], 1)
                begin = 0
                for _, blocks, e in instances(size, percent):
                    if blocks:
                        own, often = keys[begin : begin + blocks], seen[begin : begin + blocks]
                        begin += blocks
                        rarest = np.lexsort((own, often))[: blocks - e]
                        kept = own[rarest[often[rarest] > 1]]
                        out_key.append(kept)
                        out_sig.extend([sig] * len(kept))
                        out_size.extend([size] * len(kept))
        keys = np.concatenate(out_key) if out_key else np.zeros(0, np.uint64)
        return pa.table([pa.array(keys.view(np.int64)), pa.array(out_sig, pa.binary()), pa.array(out_size, pa.int64())], names=["key", "sig", "size"])

    answers = dealt.groupBy("chunk").applyInArrow(send, "bucket long, chunk long, hashes binary, counts binary").groupBy("bucket").applyInArrow(count, "chunk long, hashes binary, counts binary")
    return cut(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(keep, "key long, sig binary, size long"))


def most_apart(a: int | np.ndarray, b: int | np.ndarray, percent: int):
    """The largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def bit_sketch(hashes: np.ndarray, percent: int) -> bytes:
    """Parities of a power of two of bits, at least BITS_EACH for each difference allowed."""
    bits = 256
    while bits < BITS_EACH * most_apart(len(hashes), len(hashes), percent):
        bits *= 2
    place = (mix64(hashes + GOLDEN) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(blobs: list[bytes]) -> np.ndarray:
    """The sketches as rows of 64-bit words, all folded to the shortest one's length."""
    least = min(map(len, blobs)) // 8
    out = np.empty((len(blobs), least), np.uint64)
    for k, b in enumerate(blobs):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(b, "<u8").reshape(-1, least), axis=0)
    return out


def whole_sets(docs: DataFrame, signed: DataFrame, shared: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(sig, hashes, bits) of the sets that share a block with another."""
    from xxhash import xxh3_128_digest

    sigs = cut(shared.select("sig").distinct())
    wanted = cut(signed.join(small(sigs), "sig", "left_semi").groupBy("sig").agg(F.min("id").alias("id")).select("id").distinct())

    def compute(batches):
        seen: set[bytes] = set()
        for batch in batches:
            out = []
            for text in texts_of(batch.column(0)):
                hashes = shingles(text, n)
                blob = hashes.tobytes()
                if len(hashes) and (sig := xxh3_128_digest(blob)) not in seen:
                    seen.add(sig)
                    out.append((sig, blob, bit_sketch(hashes, percent)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in range(3)], names=["sig", "hashes", "bits"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).alias("d").join(small(wanted).alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")), "left_semi")
    found = texts.select("text").mapInArrow(compute, "sig binary, hashes binary, bits binary")
    return cut(found.join(small(sigs), "sig", "left_semi"))


def near_enough(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, size_a, size_b) those that the bit sketches let through. The node a star picks is in many pairs."""

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for m, k, x, y in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True):
            words = _folded([x, y])
            ok.append(int(np.bitwise_count(words[0] ^ words[1]).sum()) <= most_apart(m, k, percent))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    bits = sets.select("sig", "bits").groupBy("sig").agg(F.min("bits").alias("bits"))
    left, right = bits.select(F.col("sig").alias("a"), F.col("bits").alias("x")), bits.select(F.col("sig").alias("b"), F.col("bits").alias("y"))
    pairs = cut(pairs)
    total = pairs.count()
    found = join_salted(join_salted(pairs, left, "a", "b", pairs, total), right, "b", "a", pairs, total)
    return map_rows(found.select("a", "b", "size_a", "size_b", "x", "y"), check, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets; only the sets of these pairs move."""

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
            both = np.sort(np.concatenate([a, b]))
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            ok.append(100 * common >= percent * (len(a) + len(b) - common))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = cut(pairs.coalesce(width))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    own = sets.select("sig", "hashes").join(small(cut(ends.coalesce(width))), "sig", "left_semi")
    left, right = own.select(F.col("sig").alias("a"), F.col("hashes").alias("x")), own.select(F.col("sig").alias("b"), F.col("hashes").alias("y"))
    total = pairs.count()
    found = join_salted(join_salted(pairs, left, "a", "b", pairs, total), right, "b", "a", pairs, total)
    return map_rows(found.select("a", "b", "x", "y"), check, "a binary, b binary").coalesce(width).distinct()


def close_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rows: key, sig, size, root. Pairs (a, b) of a key's nodes of different roots that their bit sketches let through.

    The sketches join last, so that they move once. rows is read several times: cut it before.
    """
    sizes = rows.groupBy("key").agg(F.count("*").alias("held")).withColumn("runs", F.ceil(F.col("held") / F.lit(BLOCK)))
    own = join_split(rows, sizes, "key", "held", rows.count()).withColumn("run", F.pmod(F.xxhash64("sig", "key"), F.col("runs")))
    runs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1), lambda r: F.struct(F.least(r, F.col("run")).alias("i"), F.greatest(r, F.col("run")).alias("j")))
    tasks = own.select("key", "run", "sig", "size", "root", F.explode(runs).alias("p")).select("key", "p.i", "p.j", "run", "sig", "size", "root")
    tasks = tasks.join(sets.groupBy("sig").agg(F.min("bits").alias("bits")), "sig").select("key", "i", "j", "run", "sig", "size", "root", "bits")
    cells = max(64, int(sizes.count()) // 200)

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("run", "ascending")])
        key, i, j, run, size = (rows.column(c).to_numpy() for c in ("key", "i", "j", "run", "size"))
        sig, bits = rows.column("sig").to_pylist(), rows.column("bits").to_pylist()
        root = np.unique(np.array([r.hex() for r in rows.column("root").to_pylist()]), return_inverse=True)[1]
        change = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
        found: set[tuple[bytes, bytes]] = set()
        for lo, hi in zip(change[:-1].tolist(), change[1:].tolist(), strict=True):
            left = np.arange(lo, hi) if i[lo] == j[lo] else lo + np.flatnonzero(run[lo:hi] == i[lo])
            right = left if i[lo] == j[lo] else lo + np.flatnonzero(run[lo:hi] == j[lo])
            if not len(left) or not len(right):
                continue
            words = _folded(bits[lo:hi])
            apart = np.zeros((len(left), len(right)), np.int32)
            for w in range(words.shape[1]):
                apart += np.bitwise_count(words[left - lo, w][:, None] ^ words[right - lo, w][None, :])
            x, y = size[left][:, None], size[right][None, :]
            ok = (apart <= most_apart(x, y, percent)) & (100 * x >= percent * y) & (100 * y >= percent * x) & (root[left][:, None] != root[right][None, :])
            for a, b in zip(*np.nonzero(ok), strict=True):
                s, t = sig[left[a]], sig[right[b]]
                found.add((s, t) if s < t else (t, s))
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    return tasks.withColumn("cell", F.pmod(F.xxhash64("key", "i", "j"), F.lit(cells))).groupBy("cell").applyInArrow(compare, "a binary, b binary").distinct()


def link_components(shared: DataFrame, sets: DataFrame, percent: int, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """(node, root) over all links between different sets."""
    near = (F.col("size") * 100 >= F.col("other.size") * percent) & (F.col("other.size") * 100 >= F.col("size") * percent)
    held = shared.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("sig")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "sig")).alias("y"))
    n_rows = shared.count()
    width = 8 + n_rows // ROWS_EACH
    shared = cut(shared.join(held.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi").coalesce(width))
    own, roots = shared.withColumn("root", F.col("sig")), None
    for r in range(star_rounds + 1):
        if roots is not None:
            own = cut(shared.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig")).coalesce(width))
        mixed = own.groupBy("key").agg(F.count("*").alias("held"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(F.xxhash64("sig", F.lit(r)).alias("h"), "sig", "root", "size")).alias("other")).where("lo <> hi")
        if r < star_rounds:
            pairs = join_split(own, mixed.select("key", "other", "held"), "key", "held", n_rows).where((F.col("root") != F.col("other.root")) & near)
            low = F.col("sig") < F.col("other.sig")
            ends = [F.when(low, F.struct("sig", "size")).otherwise(F.struct("other.sig", "other.size")).alias("l"), F.when(low, F.struct("other.sig", "other.size")).otherwise(F.struct("sig", "size")).alias("r")]
            pairs = pairs.select(*ends).select(F.col("l.sig").alias("a"), F.col("r.sig").alias("b"), F.col("l.size").alias("size_a"), F.col("r.size").alias("size_b")).distinct()
            pairs = near_enough(pairs, sets, percent)
        else:
            left = own.join(mixed.select("key"), "key", "left_semi").select("key", "sig", "size", "root")
            pairs = close_pairs(cut(left.coalesce(width)), sets, percent)
        found = cut(verified(pairs, sets, percent, width).coalesce(width))
        if roots is None:
            roots = components(found)
        elif not found.isEmpty():  # the stars of the rounds before stand for their links
            roots = components(found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return roots


def in_common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of the left sets has in common with each of the right ones."""
    ends = []
    every = [np.concatenate(left), np.concatenate(right)]
    both = np.intersect1d(*every)
    for sets, hashes in zip((left, right), every, strict=True):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(both, hashes)
        held = np.flatnonzero(both[np.minimum(at, len(both) - 1)] == hashes) if len(both) else np.zeros(0, np.int64)
        held = held[np.argsort(at[held], kind="stable")]
        ends.append((row[held], at[held]))
    out = np.zeros((len(left), len(right)), np.int64)
    for begin in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - begin)
        tiles = []
        for n, (row, at) in zip((len(left), len(right)), ends, strict=True):
            lo, hi = np.searchsorted(at, [begin, begin + width])
            tile = np.zeros((n, width), np.float32)  # sums of at most COLUMNS ones are exact
            tile[row[lo:hi], at[lo:hi] - begin] = 1
            tiles.append(tile)
        out += (tiles[0] @ tiles[1].T).astype(np.int64)
    return out


def link_counts(roots: DataFrame, copies: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(sig, links): how many rows hold another set that links with this one. roots: node, root; copies: sig, copies."""
    members = cut(roots.withColumnRenamed("node", "sig").join(copies, "sig"))
    own = cut(sets.select("sig", "hashes").join(members, "sig").dropDuplicates(["sig"]))
    sizes = cut(own.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("hashes")).alias("bytes")).select("root", "bytes", F.greatest(F.ceil(F.col("n") / F.lit(RUN)), F.ceil(F.col("bytes") / F.lit(RUN_BYTES))).alias("runs")))
    moved = sizes.agg(F.sum(F.col("bytes") * F.col("runs"))).first()[0] or 0
    large = cut(sizes.where("runs > 1").select("root", "runs"))
    own = own.join(small(large), "root", "left").withColumn("runs", F.coalesce("runs", F.lit(1).cast("long")))
    own = own.withColumn("run", F.pmod(F.xxhash64("sig", "root"), F.col("runs")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1), lambda r: F.struct(F.least(r, F.col("run")).alias("i"), F.greatest(r, F.col("run")).alias("j")))
    tasks = own.select("root", "run", "sig", "copies", "hashes", F.explode(pairs).alias("p")).select("root", "p.i", "p.j", "run", "sig", "copies", "hashes")
    cells = max(64, int(moved) // RUN_BYTES)

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("root", "ascending"), ("i", "ascending"), ("j", "ascending"), ("run", "ascending")])
        root, sig = rows.column("root").to_pylist(), rows.column("sig").to_pylist()
        i, j, run, copies = (rows.column(c).to_numpy() for c in ("i", "j", "run", "copies"))
        sets = [np.frombuffer(b, "<u8") for b in rows.column("hashes").to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        links = np.zeros(len(rows), np.int64)
        change = [0, *(k for k in range(1, len(rows)) if root[k] != root[k - 1] or i[k] != i[k - 1] or j[k] != j[k - 1]), len(rows)]
        for lo, hi in zip(change[:-1], change[1:], strict=True):
            alone = i[lo] == j[lo]
            left = np.arange(lo, hi) if alone else lo + np.flatnonzero(run[lo:hi] == i[lo])
            right = left if alone else lo + np.flatnonzero(run[lo:hi] == j[lo])
            if not len(left) or not len(right):
                continue
            common = in_common([sets[k] for k in left], [sets[k] for k in right])
            ok = 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)
            if alone:
                np.fill_diagonal(ok, False)
            else:
                links[right] += copies[left] @ ok
            links[left] += ok @ copies[right]
        some = np.flatnonzero(links)
        return pa.table({"sig": pa.array([sig[k] for k in some], pa.binary()), "links": pa.array(links[some], pa.int64())})

    found = tasks.withColumn("cell", F.pmod(F.xxhash64("root", "i", "j"), F.lit(cells))).groupBy("cell").applyInArrow(compare, "sig binary, links long")
    return found.groupBy("sig").agg(F.sum("links").alias("links"))


def _joined(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, star_rounds: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row's id, size and sig; the whole sets that may link; (node, root) over the sets that do."""
    signed = cut(signatures(docs, id_col, text_col, n))
    count = signed.agg(F.sum("size")).first()[0] or 0
    shared = shared_blocks(sketch(docs, text_col, n, percent), count, percent)
    sets = whole_sets(docs, signed, shared, id_col, text_col, n, percent)
    return signed, sets, link_components(shared, sets, percent, star_rounds)


def _named(signed: DataFrame, roots: DataFrame) -> DataFrame:
    """(sig, copies, component_id) of the sets."""
    least = signed.where("sig is not null").groupBy("sig").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    rooted = cut(least.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "least", "copies", F.coalesce("root", "sig").alias("root")))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("held"))
    return join_split(rooted, first, "root", "held", rooted.count()).select("sig", "copies", "component_id")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id of its component)."""
    signed, _, roots = _joined(docs, id_col, text_col, n, percent, star_rounds)
    linked = join_split(signed.where("sig is not null"), cut(_named(signed, roots)), "sig", "copies", signed.count()).select("id", "size", "component_id")
    alone = signed.where("sig is null").select("id", "size", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """One row per document: id, n_shingles, component_id, n_links (other rows it links with, copies of its text among them)."""
    signed, sets, roots = _joined(docs, id_col, text_col, n, percent, star_rounds)
    roots = cut(roots)
    named = cut(_named(signed, roots))
    named = named.join(link_counts(roots, named.select("sig", "copies"), sets, percent), "sig", "left")
    named = cut(named.select("sig", "copies", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    linked = join_split(signed.where("sig is not null"), named, "sig", "copies", signed.count()).select("id", "size", "component_id", "n_links")
    alone = signed.where("sig is null").select("id", "size", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id", "n_links")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that of the least (id, sig), null ids last; all its columns unchanged, whatever their names.

    Rows are told apart by id and shingle set, so rows of one id with different texts stay or go by themselves; of equal ones
    one row stays. Rows without shingles stay, but for a repeated id and text. The ids that go are broadcast only while they
    are few.
    """
    from xxhash import xxh3_128_digest

    names = docs.columns
    place = names.index(text_col)
    docs, id_col, text_col = plain(docs), f"c{names.index(id_col)}", f"c{place}"
    signed, _, roots = _joined(docs, id_col, text_col, n, percent, STAR_ROUNDS)
    members = signed.where("sig is not null").select("id", "sig").distinct().join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    members = cut(members.withColumn("rank", F.struct(F.col("id").isNull().alias("none"), "id", "sig")))
    first = members.groupBy("root").agg(F.min("rank").alias("first"), F.count("*").alias("held"))
    gone = cut(join_split(members, first, "root", "held", members.count()).where("rank <> first").select(F.col("id").alias("gone_id"), F.col("sig").alias("gone_sig")))
    again = cut(signed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select(F.col("id").alias("again")))
    kept = docs.join(small(cut(gone.where("gone_id is not null").join(small(again), F.col("gone_id") == F.col("again"), "left_anti").select("gone_id"))), docs[id_col] == F.col("gone_id"), "left_anti")
    if again.isEmpty():
        return kept.toDF(*names)
    once = kept.join(small(again), kept[id_col].eqNullSafe(F.col("again")), "left_anti")

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, n) for t in texts_of(batch.column(place))]
        sigs = pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, sigs], names=[*batch.schema.names, "sig"])

    several = map_rows(docs.join(small(again), docs[id_col].eqNullSafe(F.col("again")), "left_semi"), sign, extended(docs.schema, sig=BinaryType()))
    stay = several.join(gone, several[id_col].eqNullSafe(gone["gone_id"]) & (several["sig"] == gone["gone_sig"]), "left_anti")
    nothing = F.col(id_col).isNull() & F.col("sig").isNull()
    one = stay.where(~nothing).withColumn("key", F.coalesce("sig", F.col(text_col).cast("binary"))).dropDuplicates([id_col, "key"])
    return once.unionByName(one.select(docs.columns)).unionByName(stay.where(nothing).select(docs.columns)).toDF(*names)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_links(table(spark, sf_dir, "documents"), n=3, percent=90)


#: All pairs that share a shingle, so for small tables.
OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS h FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
r AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id, coalesce(k.links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id LEFT JOIN k ON k.a = d.doc_id
"""

QUERIES = {"op2_ngram_join": op2_ngram_join}
SQL = {"op2_ngram_join": OP2_SQL}
