"""Helpers that the training-data operators share.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``, which is what ``bytes.split()`` yields on UTF-8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from duonet.operators.lineage import cut

__all__ = ["GOLDEN", "ascii_lower", "buckets_for", "cut", "extended", "free_name", "join_salted", "join_split", "map_rows", "mix64", "plain", "small", "table", "texts_of", "word_hashes"]

#: Odd multiplier of the finalising mix (2**64 / golden ratio).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-cases A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value of a string column; null gives empty bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py() or b""


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, so that every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the words, the same on every executor."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def plain(df: DataFrame) -> DataFrame:
    """The columns under names of their places: Spark's Arrow functions look columns up by name and stumble over dots."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str | StructType) -> DataFrame:
    """Applies fn to each Arrow batch (Spark bounds batches by rows and by bytes). Columns can have any names."""
    names = df.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows and (out := fn(batch.rename_columns(names))) is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return plain(df).mapInArrow(run, schema)


#: So many ids or signatures (a few MB) are broadcast at most.
MOST_BROADCAST = 200_000


def small(keys: DataFrame) -> DataFrame:
    """Marks a table of single keys for broadcast if it has at most MOST_BROADCAST rows; else Spark shuffles both sides."""
    return F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys


#: Keys that join_split() broadcasts have more rows than LEAST_HOT and than this fraction of all rows, 1 / MOST_HOT.
LEAST_HOT, MOST_HOT = 64, 50_000


def join_split(rows: DataFrame, known: DataFrame, key: str, held: str, total: int) -> DataFrame:
    """rows joined to known, which has one row a key and, in held, how many of the `total` rows have it.

    Rows of hot keys stay where they are and meet a broadcast of at most MOST_HOT of known's rows; the others are shuffled. So
    no task gathers the rows of a hot key, whatever their number. rows is read twice: cut it before.
    """
    hot = max(LEAST_HOT, total // MOST_HOT)
    few = F.broadcast(known.where(F.col(held) > hot))
    rest = rows.join(few.select(key), key, "left_anti").join(known.where(F.col(held) <= hot), key)
    return rows.join(few, key).unionByName(rest)


def join_salted(rows: DataFrame, known: DataFrame, key: str, by: str, pairs: DataFrame, total: int) -> DataFrame:
    """rows joined to known, which has one row a key, where known's rows are too large to broadcast.

    pairs holds the `total` keys of rows and is read by itself: cut it before. Rows of hot keys are dealt over salts by the
    column `by`, and known's row of such a key is repeated for each salt: at most 2 * MOST_HOT rows more, at any size. Only hot
    keys and their numbers of salts are broadcast, at most MOST_HOT rows.
    """
    hot = max(LEAST_HOT, total // MOST_HOT)
    few = F.broadcast(pairs.groupBy(key).agg(F.count("*").alias("salts")).where(F.col("salts") > hot).select(key, F.ceil(F.col("salts") / F.lit(hot)).alias("salts")))
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    left = rows.join(few, key, "left").withColumn("salt", F.pmod(F.xxhash64(by), salts)).drop("salts")
    right = known.join(few, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    return left.join(right, [key, "salt"]).drop("salt")


def extended(schema: StructType, **added: DataType) -> StructType:
    """The schema with more columns; built from types, so any names and nested fields do."""
    return StructType([*schema.fields, *(StructField(name, kind) for name, kind in added.items())])


def free_name(taken: Iterable[str], wanted: str) -> str:
    """The wanted name, with underscores behind it until no column has it (letters' case aside)."""
    taken = {t.lower() for t in taken}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def buckets_for(total: float, each: float, least: int = 1) -> int:
    """A power of two so that each of so many buckets holds about `each` of `total`."""
    n = max(least, 1)
    while n * each < total:
        n *= 2
    return n
