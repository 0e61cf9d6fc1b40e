"""Texts as chunks of numbered distinct tokens, and a global exchange of each distinct token.

A chunk is a bounded run of documents of one task. Its tokens are numbered by falling frequency; the chunk's own row keeps
every document's tokens in order as those numbers (the exploded tokens with their positions, packed), and its distinct tokens
go, packed, to the buckets of a token hash. A bucket sees each distinct token of the corpus once, whatever its frequency, and
answers every chunk with one value for each of its tokens; the chunk joins the answers back and puts its documents together
by position. A token is one entry for each chunk at most, so a hot token is no hot key.

Both kinds of rows come from one reading of the texts and travel in one exchange, by one key: a token row's is its bucket, a
chunk's own row has a key behind all buckets. Spark writes that exchange once, and both the buckets and the chunks read it,
each passing over the rows that are not theirs.

Tokens and positions must belong to the same chunk, also when tasks run again, so the input's rows need a fixed order:
steady() sees to that, and a digest of the chunk's tokens travels with both kinds.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from duonet.llm._common import buckets_for, cut

CHUNK_BYTES, BUCKET_TEXT_BYTES, LEAST_BUCKETS = 8 << 20, 16 << 20, 16


def squeeze(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def expand(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def pack_numbers(x: np.ndarray) -> bytes:
    """32-bit numbers as squeezed byte planes."""
    return squeeze(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_numbers(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(data, 4 * n), np.uint8).reshape(4, n).T).reshape(-1).view("<u4")


def pack_long(x: np.ndarray) -> bytes:
    return pack_numbers(np.concatenate([x & 0xFFFFFFFF, x >> 32]))


def unpack_long(data: bytes, n: int) -> np.ndarray:
    both = unpack_numbers(data, 2 * n).astype(np.int64)
    return both[:n] | (both[n:] << 32)


def pack_tokens(tokens: list[bytes]) -> tuple[bytes, bytes, int]:
    """Lengths, squeezed bytes, number of bytes."""
    joined = b"".join(tokens)
    return pack_numbers(np.fromiter(map(len, tokens), np.uint32, len(tokens))), squeeze(joined), len(joined)


def unpack_tokens(lengths: bytes, data: bytes, n: int, size: int) -> list[bytes]:
    ends = np.cumsum(unpack_numbers(lengths, n)).tolist()
    joined = expand(data, size)
    return [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def steady(docs: DataFrame) -> DataFrame:
    """The rows in an order that running again does not change: rows that come out of a shuffle are cut at a checkpoint."""
    return cut(docs) if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def spread_chunks(docs: DataFrame, tokenize: Callable[[str], list], as_bytes: bool, n_buckets: int, flag: Callable | None = None, label: Callable | None = None) -> DataFrame:
    """docs: id and text. Rows of two kinds, by key: under n_buckets a chunk's tokens of that bucket (n, lengths, data, size,
    used); from n_buckets on a chunk's own row (ids, flags, counts, n, numbers, place, n_distinct, labels). Both carry the
    chunk's number and digest.

    tokenize: bytes or str (as_bytes) to a list of tokens. flag: marks documents by id; tokens then carry how often they
    occur in marked documents (used). label: numbers for a list of tokens, kept in the own row (labels).
    """
    from xxhash import xxh3_64_intdigest

    docs = steady(docs.toDF("id", "text"))
    long, binary = LongType(), BinaryType()
    kinds = {"key": long, "chunk": long, "digest": long, "ids": ArrayType(docs.schema["id"].dataType), "flags": ArrayType(BooleanType()), "counts": ArrayType(IntegerType()), "n": long, "numbers": binary, "place": binary, "n_distinct": long, "labels": binary, "lengths": binary, "data": binary, "size": long, "used": binary}

    def close(chunk: int, ids: list, rows: list[np.ndarray], known: dict, flags: list, id_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        arrow = {"ids": pa.list_(id_kind), "flags": pa.list_(pa.bool_()), "counts": pa.list_(pa.int32())}
        arrow |= dict.fromkeys(("key", "chunk", "digest", "n", "n_distinct", "size"), pa.int64()) | dict.fromkeys(("numbers", "place", "labels", "lengths", "data", "used"), pa.binary())
        counts = [len(r) for r in rows]
        every = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        names = list(known)
        freq = np.bincount(every, minlength=len(names))
        order = np.argsort(-freq, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        ranked = [names[k] if as_bytes else names[k].encode() for k in order]
        del names
        known.clear()
        bucket = (np.fromiter(map(xxh3_64_intdigest, ranked), np.uint64, len(ranked)) >> np.uint64(1)).astype(np.int64) % n_buckets
        place = np.argsort(bucket, kind="stable")  # tokens in bucket order, as ranks
        bounds = np.searchsorted(bucket[place], np.arange(n_buckets + 1))
        used = np.bincount(rank[every[np.repeat(np.array(flags, bool), counts)]], minlength=len(ranked)) if flags else np.zeros(len(ranked))
        digest = xxh3_64_intdigest(b"".join(ranked)) >> 1

        def batch(**row) -> pa.RecordBatch:
            row = {"chunk": chunk, "digest": digest} | row
            return pa.RecordBatch.from_arrays([pa.array([row.get(k)], type=arrow[k]) for k in kinds], names=list(kinds))

        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = place[bounds[b] : bounds[b + 1]]
            lengths, data, size = pack_tokens([ranked[k] for k in own])
            yield batch(key=b, n=len(own), lengths=lengths, data=data, size=size, used=pack_numbers(used[own]) if flags else b"")
        yield batch(key=n_buckets + chunk, ids=ids, flags=flags, counts=counts, n=len(every), numbers=pack_numbers(rank[every]), place=pack_numbers(place), n_distinct=len(ranked), labels=pack_numbers(label(ranked)) if label else b"")

    def run(batches):
        part = TaskContext.get().partitionId() << 32
        serial = itertools.count()
        known: defaultdict = defaultdict()
        known.default_factory = known.__len__
        ids, rows, flags, size, id_kind = [], [], [], 0, None
        for batch in batches:
            id_kind = batch.column(0).type
            texts = batch.column(1).cast(pa.binary()) if as_bytes else batch.column(1)
            marks = flag(batch.column(0)) if flag else None
            for k, (i, text) in enumerate(zip(batch.column(0).to_pylist(), texts, strict=True)):
                text = text.as_py() or (b"" if as_bytes else "")
                found = tokenize(text)
                ids.append(i)
                rows.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)).astype(np.uint32))
                if marks is not None:
                    flags.append(marks[k])
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield from close(part + next(serial), ids, rows, known, flags, id_kind)
                    ids, rows, flags, size = [], [], [], 0
        if ids:
            yield from close(part + next(serial), ids, rows, known, flags, id_kind)

    return docs.mapInArrow(run, StructType([StructField(k, v) for k, v in kinds.items()]))


def n_buckets_for(total_bytes: int) -> int:
    return buckets_for(total_bytes, BUCKET_TEXT_BYTES, LEAST_BUCKETS)


def own_row(rows: pa.Table, n_buckets: int) -> dict | None:
    """The chunk's own row, where the group is a chunk's."""
    return rows.to_pylist()[0] if rows.num_rows and rows.column("key")[0].as_py() >= n_buckets else None


def by_token(answers: list[dict], row: dict, value: Callable[[dict], np.ndarray]) -> np.ndarray:
    """The answers' values, one for each of the chunk's tokens, in the order of the tokens' numbers."""
    if any(a["digest"] != row["digest"] for a in answers):
        raise RuntimeError("the input gave other rows on a second reading; checkpoint it first")
    found = [value(a) for a in sorted(answers, key=lambda a: a["bucket"])]
    out = np.zeros(row["n_distinct"], np.int64)
    if found:
        out[unpack_numbers(row["place"], row["n_distinct"])] = np.concatenate(found)
    return out
