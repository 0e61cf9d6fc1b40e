"""Variable-capacity best-fit packing.

A document takes its words plus one end token. Several sequence lengths are permitted, and all are used together: pieces
come longest first, each goes to the open bin with the least room that holds it, and where none does, the bin size with
the least cost per used token is opened. A sequence of c tokens costs ``c + charge + c * c / quadratic``: its padding counts,
every sequence has a fixed charge, and attention grows with the square, so a long bin must earn its length by filling better
than a short one. What a size would hold is found by a trial: the shard's remaining pieces, longest first, are put into it
as far as they fit. At the end every bin shrinks to the least permitted length that holds its contents. A document longer
than the longest length is split into full pieces and a rest.

Pieces are dealt by a hash into shards of about the same, bounded number of pieces, and each shard is packed by itself: its
unfilled last bins are few against its thousands of pieces, and no task's work grows with the input. A bin's name is its
shard and its number there, so no two bins share one.

Defined results: a null or empty text takes one end token. Every input row is placed whole; repeated rows are placed each.
Ties in length go by id, piece and a row number that only repeated or null ids have. An empty table gives no rows. Only the
named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from duonet.llm._common import cut, map_rows, small, table, texts_of

#: Permitted sequence lengths of the registered query.
LENGTHS = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs besides its padded length: a fixed charge, and its squared length over this, in tokens.
SEQUENCE_COST, QUADRATIC = 16, 32_768
SHARD_PIECES = 20_000


def sequence_costs(permitted: tuple[int, ...], charge: int = SEQUENCE_COST, quadratic: float = QUADRATIC) -> dict[int, float]:
    return {c: c + charge + c * c / quadratic for c in permitted}


def trial_fill(ascending: list[int], below: int, room: int) -> int:
    """How much of the room the pieces ascending[:below] fill, the longest that fits first."""
    filled = 0
    while room and below:
        below = bisect_right(ascending, room, 0, below)
        if not below:
            break
        below -= 1
        filled += ascending[below]
        room -= ascending[below]
    return filled


def pack(lengths: list[int], permitted: tuple[int, ...], charge: int = SEQUENCE_COST, quadratic: float = QUADRATIC) -> tuple[list[int], list[int], list[int]]:
    """lengths: descending, none over the longest permitted. Returns each piece's bin and offset, and each bin's length."""
    permitted = tuple(sorted(permitted))
    costs = sequence_costs(permitted, charge, quadratic)
    ascending = lengths[::-1]
    room: list[int] = []  # distinct rooms of open bins, ascending
    bins_with: dict[int, list[int]] = {}
    used: list[int] = []
    where, offset = [], []

    def put(room_left: int, b: int) -> None:
        if room_left:
            if room_left not in bins_with:
                bins_with[room_left] = []
                insort(room, room_left)
            bins_with[room_left].append(b)

    for k, length in enumerate(lengths):
        i = bisect_left(room, length)
        if i < len(room):
            left = room[i]
            b = bins_with[left].pop()
            if not bins_with[left]:
                del bins_with[left]
                room.pop(i)
        else:
            b = len(used)
            used.append(0)
            behind = len(lengths) - 1 - k
            left = min((c for c in permitted if c >= length), key=lambda c: (costs[c] / (length + trial_fill(ascending, behind, c - length)), c))
        where.append(b)
        offset.append(used[b])
        used[b] += length
        put(left - length, b)
    return where, offset, [permitted[bisect_left(permitted, u)] for u in used]


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", permitted: tuple[int, ...] = LENGTHS, charge: int = SEQUENCE_COST, quadratic: float = QUADRATIC) -> DataFrame:
    """One row per piece: id, piece, start and length in its document (tokens), bin_id, capacity, bin_offset, bin_used."""
    permitted = tuple(sorted(set(permitted)))
    longest = permitted[-1]
    id_kind = docs.schema[id_col].dataType
    kind = lambda *fields: StructType([StructField("id", id_kind), *(StructField(f, LongType()) for f in fields)])

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = pa.array([len(t.split()) + 1 for t in texts_of(batch.column(1))], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), n], names=["id", "tokens"])

    # rows whose id occurs again, or is null, are told apart by a number of their own, fixed at the checkpoint; others have 0,
    # so that with unique ids the packing does not depend on how the rows are partitioned
    measured = cut(map_rows(docs.select(id_col, text_col), measure, kind("tokens")).withColumn("row", F.monotonically_increasing_id() + 1))
    again = cut(measured.groupBy("id").count().where("count > 1 or id is null").select(F.col("id").alias("again"), F.lit(True).alias("repeated")))
    measured = measured.join(small(again), F.col("id").eqNullSafe(F.col("again")), "left").select("id", "tokens", F.when(F.col("repeated"), F.col("row")).otherwise(F.lit(0)).alias("row"))
    pieces_of = F.ceil(F.col("tokens") / F.lit(longest))
    n_shards = max(1, -(-(measured.agg(F.sum(pieces_of)).first()[0] or 0) // SHARD_PIECES))
    pieces = measured.select("id", "row", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), pieces_of - 1)).alias("piece"))
    pieces = pieces.select("id", "row", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest).cast("long"), F.col("tokens") - F.col("piece") * longest).alias("length"))
    # the hash holds the row's number and the piece's, so that neither repeated rows nor one long text pile up in a shard
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.col("id").cast("string"), "row", "piece", "length"), F.lit(n_shards)))

    def pack_shard(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        where, offset, down = pack(rows.column("length").to_pylist(), permitted, charge, quadratic)
        used = np.zeros(len(down), np.int64)
        np.add.at(used, where, rows.column("length").to_numpy())
        first = rows.column("shard")[0].as_py() << 32
        b = np.array(where, np.int64)
        columns = [rows.column(c) for c in ("id", "piece", "start", "length")]
        return pa.table([*columns, pa.array(b + first), pa.array(np.array(down, np.int64)[b]), pa.array(np.array(offset, np.int64)), pa.array(used[b])], names=["id", "piece", "start", "length", "bin_id", "capacity", "bin_offset", "bin_used"])

    packed = dealt.groupBy("shard").applyInArrow(pack_shard, kind("piece", "start", "length", "bin_id", "capacity", "bin_offset", "bin_used"))
    return packed.withColumnRenamed("id", id_col)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
SQL: dict[str, str] = {}
