r"""Hidden Markov language model: Baum-Welch counts from all partitions train the states, scaled forward recursion scores.

Tokens are the words of the text with A-Z lower-cased, then one end token. The model is a hidden Markov chain whose states
emit symbols. A frequent word has a symbol of its own (nearly: words share one where their hashes meet), a rare or unknown
word the symbol of its class, which comes from its first two and last three bytes. A symbol of several words emits them by
their share in it, whatever the state:

    P(text) = sum over state paths of prod P(state | before) P(symbol | state), times prod P(word | symbol)

What is learned grows with the corpus: all words are counted, and OWN * sqrt(V) of V distinct training words have symbols of
their own, the most frequent ones; classes are as many as a quarter of those. So the states' tables grow with the square
root of the vocabulary (about 40 MB at a thousand million words). Within a class of n tokens and v distinct words, a known word
has c / (n + v), and v / (n + v) is left for words that training never saw (together one word of the class); a frequent
word's symbol leaves nothing. So the model is a proper distribution over texts of known words and one unknown word per class.

Training: one pass of the corpus numbers the tokens of bounded chunks (see _chunks) and counts every distinct word once for
each chunk; the counts join back, and the numbered chunks are written once with them, beside the vocabulary. Each
Baum-Welch round reads these, finds the tokens' symbols by their counts, adds up expected counts inside each task and sums them in Spark. For training, documents of
more than SEGMENT tokens are cut into runs, each later run's first state from a distribution of its own; all tokens of
training documents take part. Scoring is exact over whole documents.

Defined results: a null or empty text is the end token alone. Without training documents all counts are zero and the model is
uniform over symbols. Every input row gives one row, repeated rows included; an empty table gives none. A null id is not
held out. Only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from duonet.llm._chunks import by_token, n_buckets_for, own_row, pack_long, pack_numbers, spread_chunks, text_bytes, unpack_long, unpack_numbers, unpack_tokens
from duonet.llm._common import cut, map_rows, table

STATES, ROUNDS, SEGMENT, SEED = 8, 6, 2048, 7
#: Words with symbols of their own, for each unit of the square root of the vocabulary; they occur LEAST_OWN times at least.
OWN, LEAST_OWN = 8, 4
#: Weight of the symbols' overall shares in each state's table.
PRIOR = 50.0


def tokens_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes.lower() and bytes.split() know ASCII only


def word_keys(words: list[bytes]) -> np.ndarray:
    """Two 32-bit hashes of each word, all first ones first: of its first two and last three bytes, and of the whole word."""
    from xxhash import xxh3_64_intdigest

    ends = np.fromiter((xxh3_64_intdigest(w[:2] + b"|" + w[-3:]) for w in words), np.uint64, len(words))
    whole = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    return (np.concatenate([ends, whole]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass(frozen=True)
class Symbols:
    """Which symbol a word has: slots for the words that occur `least` times, then classes for the others, then the end."""

    least: int
    slots: int
    classes: int

    @property
    def end(self) -> int:
        return self.slots + self.classes

    def of(self, ends: np.ndarray, whole: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.where(counts >= self.least, whole % self.slots, self.slots + ends % self.classes)


def choose_symbols(histogram: dict[int, int]) -> Symbols:
    """histogram: how many words have so many occurrences (the lower ends of count_bin())."""
    wanted = OWN * math.sqrt(sum(histogram.values()))
    slots = 1 << max(10, math.ceil(math.log2(max(2 * wanted, 1))))
    least, held = 1 << 62, 0
    for count in sorted((c for c in histogram if c >= LEAST_OWN), reverse=True):
        held += histogram[count]
        if held > wanted:
            break
        least = count
    return Symbols(least, slots, slots // 4)


def count_bin(counts: np.ndarray) -> np.ndarray:
    """The lower end of each count's bin: exact below 64, then eight bins for each doubling."""
    low = np.maximum(counts, 1)
    step = 1 << np.maximum(np.floor(np.log2(low)).astype(np.int64) - 3, 0)
    return np.where(counts < 64, counts, low // step * step)


def is_held_out(doc_id: object) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@dataclass(frozen=True)
class Chain:
    """first, again: distributions of the first state of a document and of a later run; move: K x K; emit: classes x K."""

    first: np.ndarray
    again: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest first: the order, the number of sequences still running at each step, and where each step's rows start."""
    order = np.argsort(-lengths, kind="stable")
    running = len(lengths) - np.cumsum(np.bincount(lengths))[:-1] if len(lengths) else np.zeros(0, np.int64)
    return order, running, np.concatenate([[0], np.cumsum(running)])


def _by_step(values: np.ndarray, starts: np.ndarray, running: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values of all sequences, step by step; starts in layout order."""
    step = np.repeat(np.arange(len(running)), running)
    return values[starts[np.arange(at[-1]) - at[step]] + step]


def expected_counts(chain: Chain, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (first, again, move, emit) and log likelihood of sequences values[start : start + length]."""
    k = len(chain.first)
    order, running, at = _layout(lengths)
    starts, opens = starts[order], opens[order]
    symbols = _by_step(values, starts, running, at)
    emission = chain.emit[symbols]
    alpha, scale = np.empty((at[-1], k)), np.empty(at[-1])
    state = np.where(opens[:, None], chain.first, chain.again)
    for t, n in enumerate(running):
        rows = slice(at[t], at[t + 1])
        state = (state if t == 0 else state[:n] @ chain.move) * emission[rows]
        total = state.sum(1)
        state /= total[:, None]
        alpha[rows], scale[rows] = state, total
    move = np.zeros((k, k))
    beta = np.ones((0, k))
    gamma = alpha
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        rows = slice(at[t], at[t + 1])
        whole = np.ones((n, k))
        if len(beta):
            ahead = slice(at[t + 1], at[t + 2])
            m = len(beta)
            weighted = emission[ahead] * beta / scale[ahead][:, None]
            move += alpha[rows][:m].T @ weighted
            whole[:m] = weighted @ chain.move.T
        beta = whole
        gamma[rows] *= beta  # alpha of this step is not needed again
    move *= chain.move
    emit = np.stack([np.bincount(symbols, weights=gamma[:, s], minlength=len(chain.emit)) for s in range(k)], 1)
    head = gamma[: len(starts)] if len(running) else np.zeros((0, k))
    return head[opens].sum(0), head[~opens].sum(0), move, emit, float(np.log(scale).sum())


def log10_likelihoods(chain: Chain, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Exact log10 probability of each sequence, by the scaled forward recursion."""
    order, running, at = _layout(lengths)
    symbols = _by_step(values, starts[order], running, at)
    out = np.zeros(len(lengths))
    state = np.tile(chain.first, (len(lengths), 1))
    for t, n in enumerate(running):
        state = (state if t == 0 else state[:n] @ chain.move) * chain.emit[symbols[at[t] : at[t + 1]]]
        total = state.sum(1)
        state /= total[:, None]
        out[:n] += np.log10(total)
    back = np.empty(len(lengths))
    back[order] = out
    return back


def start_chain(shares: np.ndarray, states: int = STATES, seed: int = SEED) -> Chain:
    rng = np.random.default_rng(seed)
    emit = shares[:, None] * rng.lognormal(0.0, 1.0, (len(shares), states))
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Chain(np.full(states, 1 / states), np.full(states, 1 / states), move, emit / emit.sum(0))


def improve(chain: Chain, shares: np.ndarray, first: np.ndarray, again: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Chain:
    share = lambda x: (x + 0.1) / (x + 0.1).sum()
    move = (move + 0.1) / (move + 0.1).sum(1, keepdims=True)
    return Chain(share(first), share(again), move, (emit + PRIOR * shares[:, None]) / (emit.sum(0) + PRIOR))


def _symbols(row: dict, symbols: Symbols, known: np.ndarray) -> np.ndarray:
    """The symbol of each token of a row, by the tokens' hashes and counts."""
    keys = unpack_numbers(row["labels"], 2 * len(known)).astype(np.int64)
    return symbols.of(keys[: len(known)], keys[len(known) :], known)


def _sequences(row: dict, kinds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the documents of a chunk one after another, each with its end; starts and lengths. kinds: the tokens' symbols."""
    words = kinds[unpack_numbers(row["numbers"], row["n"])]
    counts = np.array(row["counts"], np.int64)
    ends = np.cumsum(counts + 1) - 1
    values = np.full(len(words) + len(counts), end, np.int64)
    inner = np.ones(len(values), bool)
    inner[ends] = False
    values[inner] = words
    return values, ends - counts, counts + 1


def _rounds(chunks: DataFrame, chain: Chain, symbols: Symbols, shares: np.ndarray, rounds: int) -> Chain:
    spark = chunks.sparkSession
    k, size = len(chain.first), len(chain.emit)
    rows = chunks.select("counts", "n", "numbers", "n_distinct", "labels", "known", "flags")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(chain)  # symbols x states numbers

        def count(batches, shared=shared):
            total = np.zeros((size + k + 2, k))
            for batch in batches:
                for row in batch.to_pylist():
                    kinds = _symbols(row, symbols, unpack_long(row["known"], row["n_distinct"]))
                    values, starts, lengths = _sequences(row, kinds, size - 1)
                    own = np.flatnonzero(np.array(row["flags"], bool))
                    if not len(own):
                        continue
                    runs = -(-lengths[own] // SEGMENT)
                    nth = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
                    begin = np.repeat(starts[own], runs) + nth * SEGMENT
                    length = np.minimum(SEGMENT, np.repeat(starts[own] + lengths[own], runs) - begin)
                    first, again, move, emit, _ = expected_counts(shared.value, values, begin, length, nth == 0)
                    total[:size] += emit
                    total[size:] += np.concatenate([move, [first], [again]])
            at = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(total[at, s].astype(np.float32)) for s in range(k))], names=["at", *(f"s{s}" for s in range(k))])

        parts = rows.mapInArrow(count, "at int, " + ", ".join(f"s{s} float" for s in range(k)))
        sums = parts.groupBy("at").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(k))).toArrow()  # at most symbols + states + 2 rows
        total = np.zeros((size + k + 2, k))
        at = sums.column("at").to_numpy()
        for s in range(k):
            total[at, s] = sums.column(f"s{s}").to_numpy()
        chain = improve(chain, shares, total[size + k], total[size + k + 1], total[size : size + k], total[:size])
        shared.unpersist()
    return chain


def hmm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out=is_held_out, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    id_kind = docs.schema[id_col].dataType
    n_buckets = n_buckets_for(text_bytes(docs, text_col))
    spread = spread_chunks(docs, tokens_of, True, n_buckets, lambda ids: [not held_out(i) for i in ids.to_pylist()], word_keys)
    answer = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("known", pa.binary()), ("keys", pa.binary())])

    def count_bucket(rows: pa.Table) -> pa.Table:
        """Each distinct word's training count, to every chunk that has it; and, under a negative key, all words' counts and hashes."""
        out: dict[str, list] = {name: [] for name in answer.names}

        def put(*values) -> None:
            for name, v in zip(answer.names, values, strict=True):
                out[name].append(v)

        bucket = rows.column("key")[0].as_py()
        if bucket < n_buckets:
            held = [(r["chunk"], r["digest"], unpack_tokens(r["lengths"], r["data"], r["n"], r["size"]), unpack_numbers(r["used"], r["n"])) for r in rows.to_pylist()]
            total: dict[bytes, int] = {}
            for _, _, tokens, used in held:
                for t, c in zip(tokens, used.tolist(), strict=True):
                    if c:
                        total[t] = total.get(t, 0) + c
            for chunk, digest, tokens, _ in held:
                put(n_buckets + chunk, digest, bucket, len(tokens), pack_long(np.fromiter((total.get(t, 0) for t in tokens), np.int64, len(tokens))), b"")
            put(-1 - bucket, 0, bucket, len(total), pack_long(np.fromiter(total.values(), np.int64, len(total))), pack_numbers(word_keys(list(total))))
        return pa.table(out, schema=answer)

    answers = spread.groupBy("key").applyInArrow(count_bucket, "key long, digest long, bucket long, n long, known binary, keys binary")
    kept = ("ids", "flags", "counts", "n", "numbers", "n_distinct", "labels")
    ready_schema = StructType([*(spread.schema[c] for c in kept), StructField("known", BinaryType())])

    def ready(rows: pa.Table, found: pa.Table) -> pa.Table:
        """A chunk's own row with its tokens' counts; and the rows of the vocabulary, without ids."""
        row, replies = own_row(rows, n_buckets), found.to_pylist()
        if row:
            made = [{**row, "known": pack_long(by_token(replies, row, lambda a: unpack_long(a["known"], a["n"])))}]
        else:
            made = [{"n": 0, "n_distinct": a["n"], "labels": a["keys"], "known": a["known"]} for a in replies]
        types = [*(rows.schema.field(c).type for c in kept), pa.binary()]
        return pa.table([pa.array([r.get(c) for r in made], t) for c, t in zip(ready_schema.names, types, strict=True)], names=ready_schema.names)

    # one plan, so that the buckets and the chunks read the same exchange
    both = cut(spread.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(ready, ready_schema))
    chunks, vocabulary = both.where("ids is not null"), both.where("ids is null").select("n_distinct", "labels", "known")

    def bins(batches):
        for batch in batches:
            for r in batch.to_pylist():
                low, n = np.unique(count_bin(unpack_long(r["known"], r["n_distinct"])), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(n, pa.int64())], names=["low", "n"])

    histogram = {r["low"]: r["n"] for r in vocabulary.mapInArrow(bins, "low long, n long").groupBy("low").agg(F.sum("n").alias("n")).collect()}  # eight rows for each doubling
    symbols = choose_symbols(histogram)
    end = symbols.end

    def by_symbol(batches):
        total = np.zeros((end, 2), np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                counts = unpack_long(r["known"], r["n_distinct"])
                which = _symbols(r, symbols, counts)
                total[:, 0] += np.bincount(which, weights=counts, minlength=end).astype(np.int64)
                total[:, 1] += np.bincount(which, minlength=end)
        at = np.flatnonzero(total[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at, 0]), pa.array(total[at, 1])], names=["at", "tokens", "words"])

    sums = vocabulary.mapInArrow(by_symbol, "at int, tokens long, words long").groupBy("at").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).toArrow()  # at most one row a symbol
    tokens_in, words_in = np.zeros(end + 1), np.zeros(end + 1)
    at = sums.column("at").to_numpy()
    tokens_in[at], words_in[at] = sums.column("tokens").to_numpy(), sums.column("words").to_numpy()

    ends = chunks.select(F.size(F.filter("flags", lambda x: x)).alias("n")).agg(F.sum("n")).first()[0] or 0
    tokens_in[end], words_in[end] = ends, int(ends > 0)
    n, v = int(tokens_in.sum()), int(words_in.sum())
    shares = (tokens_in + 1) / (n + len(tokens_in))
    chain = _rounds(chunks, start_chain(shares, states), symbols, shares, rounds if n else 0)
    model = spark.sparkContext.broadcast((chain, tokens_in, words_in))  # symbols x states numbers
    schema = StructType([StructField("id", id_kind), StructField("held_out", BooleanType()), *(StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")), *(StructField(c, DoubleType()) for c in ("base_score", "score"))])

    def score(batch: pa.RecordBatch) -> pa.Table:
        chain, tokens_in, words_in = model.value
        tables = []
        for r in batch.to_pylist():
            known = unpack_long(r["known"], r["n_distinct"])
            numbers = unpack_numbers(r["numbers"], r["n"])
            counts = np.array(r["counts"], np.int64)
            doc = np.repeat(np.arange(len(counts)), counts)
            kinds = _symbols(r, symbols, known)
            base = np.log10((known + 1) / (n + v + 1))
            mass = np.maximum(tokens_in[kinds] + np.where(kinds < symbols.slots, 0.0, words_in[kinds]), 1.0)
            within = np.log10(np.where(known > 0, known, np.maximum(words_in[kinds], 1.0)) / mass)
            values, starts, lengths = _sequences(r, kinds, end)
            size = len(counts)
            base_sum = np.bincount(doc, weights=base[numbers], minlength=size) + np.log10((ends + 1) / (n + v + 1))
            model_sum = np.bincount(doc, weights=within[numbers], minlength=size) + log10_likelihoods(chain, values, starts, lengths)
            n_known = np.bincount(doc, weights=(known > 0)[numbers], minlength=size).astype(np.int64) + int(ends > 0)
            flags = pa.array([not f for f in r["flags"]], pa.bool_())
            tables.append(pa.table([pa.array(r["ids"], batch.schema.field("ids").type.value_type), flags, pa.array(lengths), pa.array(n_known), pa.array(np.full(size, n, np.int64)), pa.array(base_sum), pa.array(model_sum)], names=schema.names))
        return pa.concat_tables(tables)

    return map_rows(chunks, score, schema).withColumnRenamed("id", id_col)


def op5_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op5_hmm_score": op5_hmm_score}
SQL: dict[str, str] = {}
