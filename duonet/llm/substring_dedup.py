r"""Substring deduplication: Rabin-Karp hashes of every window of tokens, counted in Spark, merged into removal intervals.

A window is ``window`` consecutive words of one document. Every word is hashed to 64 bits and a polynomial rolling hash
gives every window its own. A word goes when some window that covers it starts at two or more places, in whatever
documents; overlapping repeated windows merge into maximal intervals.

How the counting scales: documents are dealt by a hash of id and text into chunks of a bounded size; each chunk
pre-aggregates its windows (a window that a third of all documents hold is one entry for each chunk) and sends the distinct
hashes, packed and sorted, to buckets of the hash space. A bucket counts its hashes and answers each chunk with those that
repeat. The chunk meets its answers and rewrites its texts. Chunks and buckets grow in number with the input, not in size,
and the chunk of a row depends on its id and text alone, so a lost executor's chunks are rebuilt the same. Rows of one id and
one text that would fill more than a chunk (a repeated row, copies without an id) are dealt over several by a number that
is fixed at a checkpoint.

Two different windows are taken for equal only if their hashes agree. These have 64 bits, and as many further bytes of a
second, independent rolling hash as keep the expected number of false windows under FALSE_WINDOWS in the whole input (about
n**2 / 2**(bits + 1) in n windows; 96 bits at 100 TB).

Defined results: a null text has no words and stays null; texts with fewer words than a window keep all. Every input row
gives one row; repeated rows repeat each other's windows. An empty table gives none. Other columns pass unchanged, whatever
their names and types; the two counts take the names that the caller gives, which must be free.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from duonet.llm._common import buckets_for, cut, extended, mix64, plain, small, table, word_hashes

WINDOW = 35
#: Odd base of the rolling hash, 3 mod 8, so that its powers differ in many low bits.
BASE, SECOND_BASE = 0x9E3779B97F4A7C13, 0xD1B54A32D192ED03
#: Expected false windows at most, over the whole input.
FALSE_WINDOWS = 0.01
CHUNK_BYTES, BUCKET_HASH_BYTES = 6 << 20, 8 << 20
MASK = (1 << 64) - 1

_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        size = max(n, 1 << 14)
        _powers[key] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))])
    return _powers[key][:n]


def window_hashes(h: np.ndarray, window: int, base: int = BASE) -> np.ndarray:
    """The rolling hash of each run of `window` values: sum of h[i + k] * base**k modulo 2**64."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _power(base, n), out=prefix[1:])
    return (prefix[window:] - prefix[: n - window + 1]) * _power(pow(base, -1, 1 << 64), n - window + 1)


def more_bytes(n_windows: float) -> int:
    """Bytes of the second hash that keep false windows under FALSE_WINDOWS."""
    extra = 0
    while extra < 8 and n_windows**2 / 2.0 ** (65 + 8 * extra) > FALSE_WINDOWS:
        extra += 1
    return extra


def wide_hashes(words: list[bytes], window: int, extra: int) -> np.ndarray:
    """The windows' hashes: 64-bit numbers, or with more bytes strings of fixed length that sort by the first hash."""
    h = word_hashes(words)
    first = window_hashes(h, window)
    if not extra:
        return first
    both = np.empty((len(first), 8 + extra), np.uint8)
    both[:, :8] = first.astype(">u8").view(np.uint8).reshape(-1, 8)
    both[:, 8:] = mix64(window_hashes(mix64(h), window, SECOND_BASE)).view(np.uint8).reshape(-1, 8)[:, :extra]
    return both.reshape(-1).view(f"S{8 + extra}")


def _leading(hashes: np.ndarray) -> np.ndarray:
    """The first 64 bits as numbers."""
    if hashes.dtype == np.uint64:
        return hashes
    width = hashes.dtype.itemsize
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, width)[:, :8]).reshape(-1).view(">u8").astype(np.uint64)


def _pack(sorted_hashes: np.ndarray) -> bytes:
    """Without the top byte, which the bucket implies, as byte planes: sorted values compress there."""
    if sorted_hashes.dtype == np.uint64:
        return sorted_hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].T.tobytes()
    return sorted_hashes.view(np.uint8).reshape(-1, sorted_hashes.dtype.itemsize)[:, 1:].T.tobytes()


def _unpack(blob: bytes, top: int, extra: int = 0) -> np.ndarray:
    width = 7 + extra
    n = len(blob) // width
    planes = np.frombuffer(blob, np.uint8).reshape(width, n).T
    out = np.full((n, width + 1), top, np.uint8)
    if extra:
        out[:, 1:] = planes
        return out.reshape(-1).view(f"S{width + 1}")
    out[:, :7] = planes
    return out.reshape(-1).view("<u8")


def _texts(column: pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    edges = np.zeros(n + 1, np.int32)
    edges[starts] += 1
    edges[starts + window] -= 1
    return np.cumsum(edges[:n]) > 0


def _cut_layout(text: bytes, words: list[bytes], gone: np.ndarray) -> bytes:
    """The text without the gone words and the white space behind each; the rest keeps its layout."""
    out, at, kept_from = [], 0, 0
    for k, word in enumerate(words):
        start = text.index(word, at)
        if gone[k]:
            if kept_from is not None:
                out.append(text[kept_from:start])
                kept_from = None
        elif kept_from is None:
            kept_from = start
        at = start + len(word)
    if kept_from is not None:
        out.append(text[kept_from:])
    return b"".join(out)


def dealt_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The rows with an added column chunk, the number of a chunk of about CHUNK_BYTES of text each, and the bytes of all texts.

    Rows of one id and text that fill more than a chunk are found by a count; there are no more such groups than chunks.
    """
    same = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    sizes = docs.select(same.alias("same"), F.octet_length(text_col).alias("size")).groupBy("same").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    hot_rows = CHUNK_BYTES // 1000
    seen = sizes.agg(F.sum("size"), F.count_if((F.col("n") > 1) & ((F.col("size") > CHUNK_BYTES) | (F.col("n") > hot_rows)))).first()
    total, n_hot = int(seen[0] or 0), seen[1]
    n_chunks = max(1, -(-total // CHUNK_BYTES))
    if not n_hot:
        return docs.withColumn("chunk", F.pmod(same, F.lit(n_chunks)).cast("long")), total
    numbered = cut(docs.withColumn("chunk", F.monotonically_increasing_id())).withColumn("same", same)
    parts = F.greatest(F.ceil(F.col("size") / F.lit(CHUNK_BYTES)), F.ceil(F.col("n") / F.lit(hot_rows))).alias("parts")
    hot = sizes.where((F.col("n") > 1) & ((F.col("size") > CHUNK_BYTES) | (F.col("n") > hot_rows))).select("same", parts)
    spread = F.when(F.col("parts").isNotNull(), F.xxhash64("same", F.pmod("chunk", "parts"))).otherwise(F.col("same"))
    joined = numbered.join(small(hot), "same", "left")
    return joined.withColumn("chunk", F.pmod(spread, F.lit(n_chunks + n_hot)).cast("long")).select(*docs.columns, "chunk"), total


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, layout: bool = True, counts: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """All columns of docs with the text cut, plus the number of words and of removed words, under the names in counts.

    layout: kept words stay as written, white space included, and an untouched text is unchanged; else kept words are
    joined by one space.
    """
    names = docs.columns
    taken = {c.lower() for c in counts} & {c.lower() for c in names}
    if taken or counts[0].lower() == counts[1].lower():
        raise ValueError(f"the counts need two free column names: {sorted(taken)}")
    at, text_at = len(names), names.index(text_col)
    texts, total = dealt_rows(plain(docs), f"c{names.index(id_col)}", f"c{text_at}")
    extra = more_bytes(total / 5)
    n_buckets = buckets_for(total * 1.3 * (8 + extra) / 8, BUCKET_HASH_BYTES, 256)
    shift = 64 - (n_buckets.bit_length() - 1)
    schema = extended(plain(docs).schema, n_words=LongType(), n_removed=LongType())

    def hash_chunk(rows: pa.Table) -> pa.Table:
        parts = [wide_hashes(words, window, extra) for t in _texts(rows.column(text_at)) if t and len(words := t.split()) >= window]
        every = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        first = np.ones(len(every), bool)
        first[1:] = every[1:] != every[:-1]
        hashes = every[first]
        copies = np.diff(np.append(np.flatnonzero(first), len(every)))
        bounds = np.searchsorted(_leading(hashes) >> np.uint64(shift), np.arange(n_buckets + 1, dtype=np.uint64))
        out = {"bucket": [], "chunk": [], "hashes": [], "twice": []}
        chunk = rows.column(at)[0].as_py()
        for b in np.flatnonzero(np.diff(bounds)):
            lo, hi = bounds[b], bounds[b + 1]
            part = hashes[lo:hi]
            out["bucket"].append(int(b))
            out["chunk"].append(chunk)
            out["hashes"].append(_pack(part))
            out["twice"].append(_pack(part[copies[lo:hi] > 1]))
        return pa.table(out, schema=pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("twice", pa.binary())]))

    def count_bucket(rows: pa.Table) -> pa.Table:
        top = rows.column("bucket")[0].as_py() >> (64 - shift - 8)
        per_chunk = [_unpack(b, top, extra) for b in rows.column("hashes").to_pylist()]
        twice = [_unpack(b, top, extra) for b in rows.column("twice").to_pylist()]
        every = np.sort(np.concatenate(per_chunk))
        repeated = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *twice]))
        out = {"chunk": [], "repeated": []}
        if len(repeated):
            for chunk, own in zip(rows.column("chunk").to_pylist(), per_chunk, strict=True):
                place = np.minimum(np.searchsorted(repeated, own), len(repeated) - 1)
                mine = own[repeated[place] == own]
                if len(mine):
                    out["chunk"].append(chunk)
                    out["repeated"].append(mine.tobytes())
        return pa.table(out, schema=pa.schema([("chunk", pa.int64()), ("repeated", pa.binary())]))

    def rewrite(rows: pa.Table, answers: pa.Table) -> pa.Table:
        blobs = answers.column(answers.column_names.index("repeated")).to_pylist()
        repeated = np.sort(np.frombuffer(b"".join(blobs), f"S{8 + extra}" if extra else "<u8"))
        new, n_words, n_removed = [], [], []
        for text in _texts(rows.column(text_at)):
            words = (text or b"").split()
            starts = np.zeros(0, np.int64)
            if len(repeated) and len(words) >= window:
                own = wide_hashes(words, window, extra)
                place = np.minimum(np.searchsorted(repeated, own), len(repeated) - 1)
                starts = np.flatnonzero(repeated[place] == own)
            gone = _covered(len(words), starts, window) if len(starts) else None
            n_words.append(len(words))
            n_removed.append(0 if gone is None else int(gone.sum()))
            if layout:
                new.append(text if gone is None else _cut_layout(text, words, gone))
            else:
                new.append(None if text is None else b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
        columns = [pa.array(new, pa.binary()).cast(pa.string()) if k == text_at else rows.column(k) for k in range(len(names))]
        return pa.table([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=schema.names)

    packed = texts.groupBy("chunk").applyInArrow(hash_chunk, "bucket long, chunk long, hashes binary, twice binary")
    answers = packed.groupBy("bucket").applyInArrow(count_bucket, "chunk long, repeated binary")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(rewrite, schema).toDF(*names, *counts)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), layout=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
b AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
gone AS (SELECT doc_id, list(DISTINCT p) AS p FROM (SELECT doc_id, unnest(range(greatest(i, coalesce(before + 35, i)), i + 35)) AS p FROM b) GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(p), 0) AS n_gone, CASE WHEN p IS NULL THEN w ELSE (SELECT coalesce(list(x ORDER BY j), []) FROM (SELECT unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j) WHERE NOT list_contains(p, j)) END AS kept FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_gone AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

QUERIES = {"op8_substring_dedup": op8_substring_dedup}
SQL = {"op8_substring_dedup": OP8_SQL}
