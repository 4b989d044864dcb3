"""Operator 7: a Katz backoff bigram model of the corpus, and log10 probabilities of texts.

Counts.  All training words are counted.  Every one of them, the end of a text
and one class for words that training lacks are the events of the bigram counts;
every training word and the beginning of a text are histories, and after a word that
training lacks the unigram level speaks.  With a ``vocabulary_size``, all but the
most frequent words are events of the class instead, drawn from it in proportion to
their count plus one, and after them the unigram level speaks as well.

Discounts.  Bigram counts r of 1 to 5 are multiplied by Good-Turing ratios (from
the numbers of bigrams with each count; where those give none between 0 and 1,
by 1 - D / r with one constant D).  What a history loses is spread over its
unseen events by their unigram probability, so that each history's
probabilities add up to exactly 1: a history without loss counts one event more
than it has, and one that has seen all events is scaled instead.

Tables.  Bigram counts and the counts of rare words are Parquet tables partitioned by
bucket; a bigram's bucket depends on both words, so a frequent word is spread
over all of them.  To count and to look up, a task packs the distinct bigrams of a
few thousand documents and sends one compressed block to each bucket.  The task of
a bucket reads its own partition of the table, looks each token up (bigram, else
backoff weight and unigram) and gives one sum per document.  Buckets grow in
number with the corpus, not in size.  Only tables bounded by ``NUMBERED`` (or the
vocabulary size) are collected and broadcast: the frequent words and one row for each
as a history.  This is no bound of the model: any other word goes by its 64-bit hash.  A bigram
with such a word is in the bucket of its history, or of its event if the history is frequent, so
that the task of a bucket has all events of its histories and derives their backoff weights, and
what such a bigram adds to the backed-off value, from the counts alone.  The table of rare words
has a bucket's own words and those that follow them.  Only counts are stored.

Defined results: a null or blank text is its end alone; equal rows have equal
results; rows with equal or null ids stay apart; without training
text all probabilities are 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved, scratch_path
from .common import in_fold, open_store, ship, utf8

NUMBERED = 1 << 18  # frequent words that every task knows by number; no effect on results
DISCOUNTED = 5
END, BEGIN, RARE, FIRST = 0, 1, 2, 3  # ids of the special events; words follow
SHIFT = 20  # bits of an event id
CHUNK_TOKENS = 1_000_000
BUCKET_TOKENS = 6_000_000  # tokens per bucket: bounds what a task holds of the counts
DISTINCT_WORDS = 400_000  # of a task, before it passes its counts on
SEED = 42


@dataclass
class Model:
    """What every task needs; all of it bounded by the vocabulary size."""

    words: list[bytes] = field(repr=False)
    counts: np.ndarray = field(repr=False)  # by event id
    n: int
    v: int
    discount: np.ndarray = field(default=None, repr=False)  # by count, up to DISCOUNTED
    denominator: np.ndarray = field(default=None, repr=False)  # log10, by history
    alpha: np.ndarray = field(default=None, repr=False)  # log10, by history
    buckets: int = 1
    bigram_table: str = ""
    word_table: str = ""
    whole: bool = True  # whether words without a number are events and histories of their own

    @property
    def rare_tokens(self) -> int:
        return self.n - int(self.counts.sum())

    @property
    def rare_types(self) -> int:
        return max(0, self.v - len(self.words) - 1)

    @property
    def total(self) -> int:
        """Denominator of the unigram level."""
        return self.n + self.v + 1

    def unigram(self) -> np.ndarray:
        """Probability of each event; the class has those of all its words and of unseen ones."""
        p = (self.counts + 1.0) / self.total
        p[BEGIN] = 0.0
        p[RARE] = 1.0 / self.total if self.whole else (self.rare_tokens + self.rare_types + 1.0) / self.total
        return p


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` of the binary column ``data``; the null word counts the texts' ends."""

    def rows(found, ends):
        words = list(found)
        return pa.RecordBatch.from_arrays([pa.array([*words, None], pa.binary()), pa.array([*found.values(), ends], pa.int64())], names=["word", "n"])

    def count(batches):
        found, ends = Counter(), 0
        for batch in batches:
            for data in batch.column(0):
                found.update(data.as_py().lower().split())
                ends += 1
                if len(found) > DISTINCT_WORDS:
                    yield rows(found, ends)
                    found, ends = Counter(), 0
        if ends:
            yield rows(found, ends)

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _ids(data: bytes, number: dict[bytes, int]) -> tuple[list[bytes], np.ndarray]:
    words = data.lower().split()
    return words, np.fromiter(map(number.get, words, repeat(RARE)), dtype=np.int64, count=len(words))


def _numbers(model: Model) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(model.words, FIRST)}


def _hashes(words: list[bytes], at: np.ndarray) -> np.ndarray:
    """Hashes of the words at these places."""
    return np.array([xxhash.xxh64_intdigest(words[i], SEED) for i in at], dtype=np.uint64).view(np.int64)


def _numbered(model: Model, ids: np.ndarray) -> np.ndarray:
    """Whether these ids are numbers, not hashes."""
    return (ids >= 0) & (ids < len(model.counts))


def pair_key(history: np.ndarray, event: np.ndarray) -> np.ndarray:
    """64-bit hash of two ids, each a number or the hash of a word."""
    x = history.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ (x >> np.uint64(32))) + event.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def bigram_counts(texts: DataFrame, shared, buckets: int) -> DataFrame:
    """``bucket, key, event, n``: the key has the history's number above bit ``SHIFT`` and the event's below.

    Bigrams with a word that goes by its hash are in the buckets from ``buckets``
    on, by the hash of the history or else of the event, with the history's id as key and the event's in ``event``.
    """

    def count(batches):
        number, whole = _numbers(shared.value), shared.value.whole

        def batch_of(part, blocks):
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

        def rows(parts, hashed):
            ids = np.concatenate(parts)
            history, event = ids[:-1], ids[1:]
            rare = (history == RARE) | (event == RARE)
            inside = event != BEGIN
            keys = (history << SHIFT) | event
            keys, n = np.unique(keys[inside & (~rare if whole else history != RARE)], return_counts=True)
            if len(keys):
                part = bucket_of(keys, buckets)
                order = _by_bucket(part)
                keys, n, part = keys[order], n[order], part[order]
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                yield batch_of(part[starts], [_pack(keys[i:j], np.zeros(j - i), n[i:j]) for i, j in zip(starts, [*starts[1:], len(part)], strict=True)])
            if whole and (rare & inside).any():
                ids = ids.copy()
                ids[ids == RARE] = np.concatenate(hashed)
                keys, n = _counted(np.c_[ids[:-1], ids[1:]][rare & inside])
                part = np.where(_numbered(shared.value, keys[:, 0]), keys[:, 1], keys[:, 0]) % buckets
                mine = [(b, part == b) for b in np.unique(part)]
                yield batch_of([buckets + b for b, _ in mine], [_pack_pairs(keys[m], n[m]) for _, m in mine])

        parts, hashed, size = [], [], 0
        for batch in batches:
            for data in batch.column(0):
                words, ids = _ids(data.as_py(), number)
                if whole:
                    hashed.append(_hashes(words, np.flatnonzero(ids == RARE)))
                parts.append(np.r_[BEGIN, ids, END])
                size += len(parts[-1])
                if size > CHUNK_TOKENS:
                    yield from rows(parts, hashed)
                    parts, hashed, size = [], [], 0
        if parts:
            yield from rows(parts, hashed)

    def merge(blocks: pa.Table) -> pa.Table:
        if (bucket := blocks.column("bucket")[0].as_py()) >= buckets:
            found = np.concatenate([_unpack_pairs(block.as_py()) for block in blocks.column("block")], axis=1)
            keys, n = _counted(found[:2].T, found[2])
            return pa.table({"bucket": np.full(len(n), bucket, dtype=np.int32), "key": keys[:, 0].copy(), "event": keys[:, 1].copy(), "n": n})
        unpacked = [_unpack(block.as_py())[::3] for block in blocks.column("block")]
        keys, n = (np.concatenate(x) for x in zip(*unpacked, strict=True))
        del unpacked  # memory
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        place = np.full(len(first), bucket, dtype=np.int32)
        return pa.table({"bucket": place, "key": keys[first], "event": np.zeros(len(first), np.int64), "n": np.add.reduceat(n, first)})

    return texts.mapInArrow(count, "bucket int, block binary").groupBy("bucket").applyInArrow(merge, "bucket int, key long, event long, n long")


def _counted(pairs: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of pairs in order, and how often each occurs (or the sums of ``n``)."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    first = np.flatnonzero(np.r_[True, (pairs[1:] != pairs[:-1]).any(axis=1)])
    return pairs[first], np.add.reduceat(np.ones(len(pairs), np.int64) if n is None else n[order], first)


def _table(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Rows with a ``bucket`` as a table partitioned by it, one file each, and its place."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema("key long, event long, n long, bucket int").parquet(path), path


def discounts(of_counts: dict[int, int], k: int = DISCOUNTED) -> np.ndarray:
    """Factor by count, 1 from ``k + 1`` on; ``of_counts``: bigrams with each count."""
    n = [of_counts.get(r, 0) for r in range(k + 2)]
    constant = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    factors = np.ones(k + 2)
    cut = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        turing = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut) if n[r] and cut != 1 else 0.0
        factors[r] = turing if 0 < turing < 1 else 1 - constant / r
    return factors


def discounted(n: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return n * factors[np.minimum(n, len(factors) - 1)]


def history_sums(bigrams: DataFrame, shared) -> DataFrame:
    """Per numbered history: its count, what is left of it after discounting, the unigram mass and number of its events.

    Bigrams of numbers are read as rows, those with a hashed word by bucket.
    """
    spark = bigrams.sparkSession
    buckets = shared.value.buckets

    def sums(parts):
        model = shared.value
        total = np.zeros((4, len(model.counts)))
        for history, n, p in parts:
            for row, values in zip(total, (n.astype(float), discounted(n, model.discount), p, np.ones(len(n))), strict=True):
                row += np.bincount(history, weights=values, minlength=len(model.counts))
        at = np.flatnonzero(total[3])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(row[at]) for row in total)], names=["history", "n", "kept", "seen", "events"])

    def rows(batches):
        p = shared.value.unigram()
        for batch in batches:
            key, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield key >> SHIFT, n, p[key & ((1 << SHIFT) - 1)]

    def hashed(batches):
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                history, _, n, p = _wide(shared.value, bucket)
                inside = _numbered(shared.value, history)
                yield history[inside], n[inside], p[inside]

    fields = "history long, n double, kept double, seen double, events double"
    # each task gives up to a row per number, so that there are no more of them than can run
    narrow = bigrams.where(F.col("bucket") < buckets).select("key", "n").coalesce(spark.sparkContext.defaultParallelism)
    parts = narrow.mapInArrow(lambda batches: sums(rows(batches)), fields)
    if shared.value.whole:
        parts = parts.unionByName(spark.range(buckets).mapInArrow(lambda batches: sums(hashed(batches)), fields))
    return parts.groupBy("history").agg(*[F.sum(c).alias(c) for c in ("n", "kept", "seen", "events")])


def backoff(n: float, kept: float, seen: float, events: float, all_events: int) -> tuple[float, float]:
    """Denominator and weight of a history: ``kept / denominator + weight * (1 - seen)`` is 1."""
    if events >= all_events:
        return kept, 0.0
    denominator = n if kept < n * (1 - 1e-12) else n + 1.0
    return denominator, (1 - kept / denominator) / (1 - seen)


def _wide(model: Model, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams with a hashed word of one bucket, in order: histories, events, counts, and unigram probabilities of the events."""
    words, n_word = _values(model.word_table, bucket, ["n"])
    history, event, n = _values(model.bigram_table, model.buckets + bucket, ["event", "n"])
    order = np.lexsort((event, history))
    history, event, n = history[order], event[order], n[order]
    n_event = np.zeros(len(event), np.int64)
    inside = _numbered(model, event)
    n_event[inside] = model.counts[event[inside]]
    n_event[~inside] = n_word[np.searchsorted(words, event[~inside])]
    return history, event, n, (n_event + 1.0) / model.total


def _weights(model: Model, history: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed histories of a bucket's bigrams, and log10 of their denominators and weights (see ``backoff``)."""
    inside = _numbered(model, history)
    history, n, p = history[~inside], n[~inside], p[~inside]
    first = np.flatnonzero(np.r_[True, history[1:] != history[:-1]][: len(history)])
    if not len(first):
        return history, np.zeros(0), np.zeros(0)
    count, kept, seen = (np.add.reduceat(x, first) for x in (n.astype(float), discounted(n, model.discount), p))
    # the class of unseen words is never seen, so that ``backoff`` has but one case here
    denominator = np.where(kept < count * (1 - 1e-12), count, count + 1)
    return history[first], np.log10(denominator), np.log10((1 - kept / denominator) / (1 - seen))


def _gains(model: Model, bucket: int) -> list[np.ndarray]:
    """Sorted keys of a bucket's bigrams with a hashed word, and what each has beyond its backed-off value."""
    history, event, n, p = _wide(model, bucket)
    inside = _numbered(model, history)
    words, *own = _weights(model, history, n, p)
    denominator, alpha = np.zeros(len(history)), np.zeros(len(history))
    at = np.searchsorted(words, history[~inside])
    for values, numbered, hashed in zip((denominator, alpha), (model.denominator, model.alpha), own, strict=True):
        values[inside], values[~inside] = numbered[history[inside]], hashed[at]
    key = pair_key(history, event)
    order = np.argsort(key, kind="stable")
    return [key[order], (np.log10(discounted(n, model.discount)) - denominator - np.log10(p) - alpha)[order]]


def fit(docs: DataFrame, text_col: str = "text", vocabulary_size: int | None = None) -> Model:
    """The model; its tables are in the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    context = spark.sparkContext
    texts = docs.select(utf8(text_col).alias("data"))
    words = saved(word_counts(texts), "katz-words")
    n, v, ends = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))).first()
    top = words.where("word IS NOT NULL").orderBy(F.desc("n"), "word").limit(NUMBERED if vocabulary_size is None else vocabulary_size).toArrow()
    model = Model(top.column("word").to_pylist(), np.r_[ends, 0, 0, top.column("n").to_numpy()].astype(np.int64), n, v, whole=vocabulary_size is None)
    model.buckets = max(1, -(-n // BUCKET_TOKENS))
    shared = context.broadcast(model)
    bigrams, model.bigram_table = _table(bigram_counts(texts, shared, model.buckets), "katz-bigrams")
    rare = words.where("word IS NOT NULL")
    if model.words:  # the frequent words are known everywhere
        least, last = int(model.counts[-1]), model.words[-1]
        rare = rare.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > F.lit(last))))
    hashed = rare.select(F.xxhash64("word").alias("key"), "n")
    known = hashed.withColumn("bucket", F.pmod("key", F.lit(model.buckets)).cast("int"))
    if model.whole:  # and events of a hashed history that belong to other buckets
        number = F.lit(len(model.counts) - 1)
        both = bigrams.where((F.col("bucket") >= model.buckets) & ~F.col("key").between(F.lit(0), number) & ~F.col("event").between(F.lit(0), number))
        events = both.select(F.col("event").alias("key"), (F.col("bucket") - model.buckets).alias("bucket")).where(F.pmod("key", F.lit(model.buckets)) != F.col("bucket"))
        known = known.unionByName(events.distinct().join(hashed, "key"))
    _, model.word_table = _table(known.repartition("bucket").sortWithinPartitions("bucket", "key"), "katz-rare-words")
    of_counts = {r["n"]: r["bigrams"] for r in bigrams.where(F.col("n") <= DISCOUNTED + 1).groupBy("n").agg(F.count(F.lit(1)).alias("bigrams")).collect()}
    model.discount = discounts(of_counts)
    size = len(model.counts)
    # all but the beginning
    events = v - (ends > 0) + 2 if model.whole else size - 1
    total = np.zeros((4, size))
    found = history_sums(bigrams, context.broadcast(model)).toArrow()
    for row, name in zip(total, ("n", "kept", "seen", "events"), strict=True):
        row[found.column("history").to_numpy()] = found.column(name).to_numpy()
    denominator, alpha = np.ones(size), np.ones(size)
    for history in np.flatnonzero(total[3]):
        denominator[history], alpha[history] = backoff(*total[:, history].tolist(), events)
    with np.errstate(divide="ignore"):
        model.denominator, model.alpha = np.log10(denominator), np.log10(alpha)
    return model


# ---------------------------------------------------------------- blocks
def _by_bucket(part: np.ndarray) -> np.ndarray:
    """Stable order by bucket; short numbers are sorted by radix."""
    return np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")


def _in_order(keys: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Stable order by bucket and, in it, by key."""
    order = np.argsort(keys.view(np.uint64), kind="stable")
    return order[_by_bucket(part[order])]


def _squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _expand(block: bytes) -> bytes:
    return pa.Codec("zstd").decompress(block[8:], int.from_bytes(block[:8], "little"), asbytes=True)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Numbers of so many bytes, with their bytes of equal weight side by side, which packs better."""
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _from_planes(data: bytes, width: int, n: int, at: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8, width * n, at).reshape(width, n).T.copy().view(f"<u{width}").reshape(-1)


def _pack(keys: np.ndarray, docs: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted keys with the documents that have them, as differences and compressed."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    runs = np.diff(np.r_[first, len(keys)])
    head = np.array([len(first), len(keys)], dtype="<u4")
    steps = np.diff(np.r_[0, keys[first].view(np.uint64)].astype(np.uint64))
    return _squeeze(head.tobytes() + _planes(steps, 8) + _planes(runs, 4) + _planes(docs, 4) + _planes(times, 4))


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how many entries each has, and the entries' documents and times."""
    data = _expand(block)
    n, m = (int(x) for x in np.frombuffer(data, "<u4", 2))
    steps = _from_planes(data, 8, n, 8)
    runs = _from_planes(data, 4, n, 8 + 8 * n)
    docs = _from_planes(data, 4, m, 8 + 12 * n)
    times = _from_planes(data, 4, m, 8 + 12 * n + 4 * m)
    return np.cumsum(steps, dtype=np.uint64).view(np.int64), runs, docs, times


def _pack_pairs(pairs: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs in order and their counts, the first of each pair as differences, compressed."""
    first, second = pairs.view(np.uint64).T
    return _squeeze(_planes(np.diff(np.r_[np.uint64(0), first]), 8) + _planes(second, 8) + _planes(n, 8))


def _unpack_pairs(block: bytes) -> np.ndarray:
    """Three rows: the first and second of each pair, and the counts."""
    data = _expand(block)
    size = len(data) // 24
    steps, second, n = (_from_planes(data, 8, size, 8 * size * i) for i in range(3))
    return np.stack([np.cumsum(steps, dtype=np.uint64), second, n]).view(np.int64)


def _to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_all()


BIGRAM, WORD, PAIR = 0, 1, 3
DOCUMENT = 2  # kind of the blocks with what a chunk's documents know by themselves
_BLOCKS = "kind int, bucket int, chunk long, block binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("block", pa.binary())])
_FOUND = "doc_id long, held_out boolean, n_tokens long, n_known long, n_rare long, base double, fixed double, rare_sum double, alpha_sum double, pair_sum double, gain_sum double"


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of bigrams of two numbers."""
    return ((keys >> SHIFT) * 31 + (keys & ((1 << SHIFT) - 1))) % buckets


def _blocks(shared, buckets: int):
    """Task function: rows (doc_id, held_out, data) to one row per document and the blocks of each chunk of documents."""

    def batch_of(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    def run(batches):
        model = shared.value
        number = _numbers(model)
        with np.errstate(divide="ignore"):
            p = np.log10(model.unigram())
        chunk = TaskContext.get().partitionId() << 24
        held, texts = [], []  # (doc_id, held_out, hashes of words without a number) and ids
        size = 0

        def flush():
            lengths = np.array([len(x) - 1 for x in texts])
            ids = np.concatenate(texts)
            texts.clear()  # memory
            event = np.flatnonzero(ids != BEGIN)
            history, what = ids[event - 1], ids[event]
            numbers = np.arange(len(held), dtype=np.int32)
            where = np.repeat(numbers, lengths)
            add = lambda mask, values: np.bincount(where[mask], weights=values[mask], minlength=len(held)).astype(float)
            base = add(what != RARE, p[what])
            if model.whole:
                fixed = add((history == RARE) & (what != RARE), p[what]) + add((history != RARE) & (what == RARE), model.alpha[history])
            else:
                fixed = add(history == RARE, p[what])
            rare = add(what == RARE, np.ones(len(what))).astype(np.int64)
            known = add(model.counts[what] > 0, np.ones(len(what))).astype(np.int64)
            own = pa.table(
                {
                    "doc_id": pa.array([h[0] for h in held], pa.int64()),
                    "held_out": pa.array([h[1] for h in held], pa.bool_()),
                    **{"n_tokens": lengths, "n_known": known, "n_rare": rare, "base": base, "fixed": fixed},
                }
            )
            yield batch_of([DOCUMENT], [chunk % (1 << 31)], [chunk], [_to_bytes(own)])
            words = np.concatenate([h[2] for h in held])

            def kinds():
                yield WORD, words, words % buckets, np.repeat(numbers, [len(h[2]) for h in held])
                pairs = history != RARE
                if model.whole:
                    pairs &= what != RARE
                    ids[ids == RARE] = words
                    first, second = ids[event[~pairs] - 1], ids[event[~pairs]]
                    yield PAIR, pair_key(first, second), np.where(_numbered(model, first), second, first) % buckets, where[~pairs]
                keys = (history[pairs] << SHIFT) | what[pairs]
                yield BIGRAM, keys, bucket_of(keys, buckets), where[pairs]

            for kind, keys, part, at in kinds():
                if not len(keys):
                    continue
                order = _in_order(keys, part)  # the documents ascend already
                keys, at, part = keys[order], at[order], part[order]
                first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])])
                times = np.diff(np.r_[first, len(keys)])
                keys, at, part = keys[first], at[first], part[first]
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                ends = np.r_[starts[1:], len(part)]
                blocks = [_pack(keys[a:b], at[a:b], times[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield batch_of(np.full(len(starts), kind), part[starts], np.full(len(starts), chunk), blocks)

        for batch in batches:
            for doc_id, out, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                words, ids = _ids(data.as_py(), number)
                held.append((doc_id.as_py(), out.as_py(), _hashes(words, np.flatnonzero(ids == RARE))))
                texts.append(np.r_[BEGIN, ids, END])
                size += len(ids) + 1
                if size >= CHUNK_TOKENS:
                    yield from flush()
                    held, size, chunk = [], 0, chunk + 1
        if held:
            yield from flush()

    return run


def _values(path: str, bucket: int, names: list[str]) -> list[np.ndarray]:
    """Sorted keys of one partition of a table and their values."""
    store, root = open_store(path)
    folder = f"{root}/bucket={bucket}"
    if store.get_file_info(folder).type == fs.FileType.NotFound:
        return [np.zeros(0, np.int64) for _ in ["key", *names]]
    table = pq.read_table(folder, columns=["key", *names], filesystem=store, partitioning=None)
    columns = [table.column(c).to_numpy() for c in ("key", *names)]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def _entries(model: Model, kind: int, bucket: int) -> list[np.ndarray]:
    """Sorted keys of a kind and bucket: bigrams and words with their counts, words as histories also with their weights, hashed bigrams with their gains."""
    if kind == PAIR:
        return _gains(model, bucket)
    keys, n = _values(model.bigram_table if kind == BIGRAM else model.word_table, bucket, ["n"])
    if kind == BIGRAM or not model.whole:
        return [keys, n]
    history, _, n_pair, p = _wide(model, bucket)
    words, _, weights = _weights(model, history, n_pair, p)
    alpha = np.zeros(len(keys))
    alpha[np.searchsorted(keys, words)] = weights
    return [keys, n, alpha]


def _per_document(values: np.ndarray, runs: np.ndarray, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Sums by document of values by key, each as often as it occurs."""
    return np.bincount(docs, weights=np.repeat(values, runs) * times)


def _look_up(shared):
    """Task function: the blocks of a kind and bucket to one block per chunk: documents with their sums."""

    def run(rows: pa.Table) -> pa.Table:
        kind, bucket = rows.column("kind")[0].as_py(), rows.column("bucket")[0].as_py()
        if kind == DOCUMENT:
            return rows.select(["kind", "chunk", "block"])
        model = shared.value
        with np.errstate(divide="ignore"):
            p = np.log10(model.unigram())
        keys, *own = _entries(model, kind, bucket)
        out = []
        for block in rows.column("block"):
            asked, runs, docs, times = _unpack(block.as_py())
            if len(keys):
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                found, *more = (np.where(keys[at] == asked, x[at], 0) for x in own)
            else:
                found, *more = (np.zeros(len(asked), dtype=np.int64) for _ in own)
            if kind == WORD:
                value = np.log10(found + 1.0)
            elif kind == PAIR:
                value = found
            else:
                history, event = asked >> SHIFT, asked & ((1 << SHIFT) - 1)
                with np.errstate(divide="ignore"):
                    seen = np.log10(discounted(found, model.discount)) - model.denominator[history]
                value = np.where(found > 0, seen, model.alpha[history] + p[event])
            has = np.flatnonzero(np.bincount(docs))
            columns = {"at": has.astype(np.int32), "sum": _per_document(value, runs, docs, times)[has]}
            if kind == WORD:
                columns["known"] = _per_document(found > 0, runs, docs, times)[has].astype(np.int32)
                if more:
                    columns["alpha"] = _per_document(more[0], runs, docs, times)[has]
            out.append(_to_bytes(pa.table(columns)))
        return pa.table({"kind": rows.column("kind"), "chunk": rows.column("chunk"), "block": pa.array(out, pa.binary())})

    return run


def _combine(rows: pa.Table) -> pa.Table:
    """Task function: everything about a chunk to one row per document."""
    kinds = rows.column("kind").to_pylist()
    own = _from_bytes(rows.column("block")[kinds.index(DOCUMENT)].as_py())
    sums = {kind: np.zeros(own.num_rows) for kind in (BIGRAM, WORD, PAIR)}
    alpha = np.zeros(own.num_rows)
    known = own.column("n_known").to_numpy().astype(np.int64)
    # in a fixed order, so that the sums do not depend on which block came first
    for kind, block in sorted((k, b.as_py()) for k, b in zip(kinds, rows.column("block"), strict=True) if k != DOCUMENT):
        found = _from_bytes(block)
        at = found.column("at").to_numpy()
        sums[kind][at] += found.column("sum").to_numpy()
        if kind == WORD:
            known[at] += found.column("known").to_numpy().astype(np.int64)
            if "alpha" in found.column_names:
                alpha[at] += found.column("alpha").to_numpy()
    own = own.set_column(own.schema.get_field_index("n_known"), "n_known", pa.array(known))
    for name, column in (("rare_sum", sums[WORD]), ("alpha_sum", alpha), ("pair_sum", sums[BIGRAM]), ("gain_sum", sums[PAIR])):
        own = own.append_column(name, pa.array(column))
    return own


def score(docs: DataFrame, model: Model, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), utf8(text_col).alias("data"))
    blocks = rows.mapInArrow(_blocks(shared, model.buckets), _BLOCKS)
    looked = blocks.groupBy("kind", "bucket").applyInArrow(_look_up(shared), "kind int, chunk long, block binary")
    each = looked.groupBy("chunk").applyInArrow(_combine, _FOUND)
    in_class = float(np.log10(model.total if model.whole else model.rare_tokens + model.rare_types + 1.0))
    return each.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rare_sum") - F.col("n_rare") * float(np.log10(model.total))).alias("base_score"),
        (F.col("fixed") + F.col("pair_sum") + F.col("gain_sum") + F.col("alpha_sum") + F.col("rare_sum") - F.col("n_rare") * in_class).alias("score"),
    )


def score_documents(docs: DataFrame, vocabulary_size: int | None = None) -> DataFrame:
    """Learn from the documents whose crc32(id) mod 7 is not 2 and score all."""
    held = in_fold("doc_id", 7, 2)
    return score(docs, fit(docs.where(~held), vocabulary_size=vocabulary_size), held)
