"""Byte-level BPE encoding and decoding by a global exchange of distinct words.

Texts split into pre-tokens with their positions, once; each distinct pre-token of the corpus is encoded once, its ids join
back to every place it holds, and documents are put together by position (see _chunks). Decoding looks ids up in the
token-byte table: the vocabulary is a file of fixed size, so the table travels with the function that uses it.

Vocabulary files come by path; the driver reads the file and sends its content, so that executors need no copy.

Defined results: a null or empty text has no ids and decodes to no bytes. Every input row gives one row, repeated rows
included; an empty table gives none. Only the id and text columns are read. Ids are stored as little-endian unsigned 32-bit
integers in one binary column.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from duonet.llm._chunks import by_token, n_buckets_for, own_row, pack_numbers, spread_chunks, text_bytes, unpack_numbers, unpack_tokens
from duonet.llm._common import extended, free_name, map_rows, table

_loaded: dict[int, object] = {}


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}


def _encoder(vocabulary: bytes):
    """The merge engine, made once for each worker process; its pattern takes a whole text, so that it merges a pre-token as it is."""
    key = hash((vocabulary, "encoder"))
    if key not in _loaded:
        import tiktoken

        _loaded[key] = tiktoken.Encoding("vocabulary", pat_str=r"(?s:.+)", mergeable_ranks=_ranks(vocabulary), special_tokens={})
    return _loaded[key]


def _token_bytes(vocabulary: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and bytes of every id."""
    key = hash(vocabulary)
    if key not in _loaded:
        ranks = _ranks(vocabulary)
        words: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            words[rank] = word
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        _loaded[key] = (np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(words), np.uint8))
    return _loaded[key]


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start .. start + length - 1 of each pair, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def bpe_encode(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids; with decode also decoded, read back from the ids in the same task."""
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    vocab = spark.sparkContext.broadcast(vocabulary)  # a vocabulary file, of fixed size
    compiled: list = []

    def tokenize(text: str) -> list[str]:
        if not compiled:
            import regex

            compiled.append(regex.compile(pattern))
        return compiled[0].findall(text) if not compiled[0].groups else [m.group() for m in compiled[0].finditer(text)]

    n_buckets = n_buckets_for(text_bytes(docs, text_col))
    answer = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("n_ids", pa.int64()), ("counts", pa.binary()), ("ids", pa.binary())])

    def encode_bucket(rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in answer.names}
        if rows.column("key")[0].as_py() < n_buckets:
            encode = _encoder(vocab.value).encode_ordinary_batch
            done: dict[bytes, list[int]] = {}
            for r in rows.to_pylist():
                tokens = unpack_tokens(r["lengths"], r["data"], r["n"], r["size"])
                new = [t for t in tokens if t not in done]
                done.update(zip(new, encode([t.decode() for t in new], num_threads=1), strict=True))
                found = [done[t] for t in tokens]
                flat = np.fromiter((i for ids in found for i in ids), np.uint32)
                counts = np.fromiter(map(len, found), np.uint32, len(found))
                for k, v in (("key", n_buckets + r["chunk"]), ("digest", r["digest"]), ("bucket", r["key"]), ("n", r["n"]), ("n_ids", len(flat)), ("counts", pack_numbers(counts)), ("ids", pack_numbers(flat))):
                    out[k].append(v)
        return pa.table(out, schema=answer)

    id_kind = docs.schema[id_col].dataType
    schema = StructType([StructField("id", id_kind), StructField("n_tokens", LongType()), StructField("ids", BinaryType()), *([StructField("decoded", BinaryType())] if decode else [])])

    def assemble(rows: pa.Table, answers: pa.Table) -> pa.Table:
        row, found = own_row(rows, n_buckets), answers.to_pylist()
        id_type = rows.schema.field("ids").type.value_type
        ids, n_tokens = [], []
        if row:
            lengths = by_token(found, row, lambda a: unpack_numbers(a["counts"], a["n"]))
            ordered = sorted(found, key=lambda a: a["bucket"])
            flat = np.concatenate([unpack_numbers(a["ids"], a["n_ids"]) for a in ordered]) if ordered else np.zeros(0, np.uint32)
            place = unpack_numbers(row["place"], row["n_distinct"])
            starts = np.zeros(len(place), np.int64)
            starts[place] = np.cumsum(lengths[place]) - lengths[place]
            numbers = unpack_numbers(row["numbers"], row["n"])
            at = 0
            for c in row["counts"]:
                own = numbers[at : at + c]
                at += c
                got = flat[_spread(starts[own], lengths[own])] if c else flat[:0]
                n_tokens.append(len(got))
                ids.append(got.astype("<u4").tobytes())
        made = [pa.array(row["ids"] if row else [], id_type), pa.array(n_tokens, pa.int64()), pa.array(ids, pa.binary())]
        made += [pa.array([_bytes_of(blob, vocab.value) for blob in ids], pa.binary())] if decode else []
        return pa.table(made, names=schema.names)

    spread = spread_chunks(docs, tokenize, False, n_buckets)
    answers = spread.groupBy("key").applyInArrow(encode_bucket, "key long, digest long, bucket long, n long, n_ids long, counts binary, ids binary")
    return spread.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(assemble, schema).withColumnRenamed("id", id_col)


def _bytes_of(ids: bytes, vocabulary: bytes) -> bytes:
    starts, lengths, data = _token_bytes(vocabulary)
    numbers = np.frombuffer(ids, "<u4")
    return data[_spread(starts[numbers], lengths[numbers])].tobytes() if len(numbers) else b""


def bpe_decode(encoded: DataFrame, vocabulary: bytes, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """The rows, all columns unchanged, with an added binary column of the decoded bytes.

    It is named decoded_col, with underscores behind it where a column has that name. Null ids decode to no bytes, an id that
    the vocabulary lacks raises, repeated rows are decoded each, an empty table gives none.
    """
    vocab = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    at = encoded.columns.index(ids_col)
    added = free_name(encoded.columns, decoded_col)

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [_bytes_of(blob or b"", vocab.value) for blob in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, added])

    return map_rows(encoded, decode, extended(encoded.schema, **{added: BinaryType()}))


def op7_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    import public_tokenizers

    vocabulary = read_vocabulary(vocabulary_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe_encode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, decode=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
SQL: dict[str, str] = {}
