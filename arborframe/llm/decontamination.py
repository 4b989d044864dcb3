"""Operator 4: benchmark items found by canonical templates.

Texts become canonical words: numbers, units, and in one of two readings names,
are replaced by typed placeholders; other words lose case and outer punctuation.
Windows of ``WINDOW`` canonical words are hashed and joined with those of the
benchmark, so a question that was asked again with other numbers or names still
matches.  A matched window counts only if its slots are consistent: along one
alignment of a document and an item, a slot keeps the item's value or has the
value that the most slots with that item value have (among equally many, the
first one).  Windows with any other slot are left out, and only those; different
item values may get the same value.

A window with fewer than ``LITERALS`` words that are not placeholders matches only
with equal values in all of its slots.

An item is reported if consistent windows cover at least ``COVERAGE`` of its
words, or ``RUN`` words in a row along one alignment; shorter shared phrases are
not.  Before the join, a Bloom filter of fixed
size drops the windows that no item has; the join itself is exact.

Defined results: null and blank texts have no windows; items shorter than a
window are one window of their own length, and documents are searched with
windows of each such length as well; repeated rows give equal results, reported once;
a null id is reported as null; empty tables give no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .common import ship, utf8

WINDOW = 5
COVERAGE = 0.6
RUN = 13  # words in a row that are enough in an item of any length
LITERALS = 3  # words of a window that must not be placeholders
BLOOM_WORDS = 1 << 16  # 64-bit words of the filter: half a megabyte, whatever the size of the benchmark
MEMO = 400_000  # words a worker remembers before it starts anew; no effect on results
PART_CHARS = 1 << 20  # text that is worked on at a time

# Written units of measure and of money, singular and plural.
UNITS = frozenset(
    "mm cm m km kilometer kilometers kilometre kilometres meter meters metre metres mile miles inch inches foot feet yard yards "
    "mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds "
    "ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar "
    "% percent ° °c °f degree degrees "
    "$ € £ ¥ usd eur gbp dollar dollars euro euros cent cents".split()
)

_NUMBER = re.compile(r"([+\-]?[$€£¥]?)(\d[\d.,:/]*)(.*)", re.S)
_OUTER = re.compile(r"^[^\w$€£¥%°+\-]+|[^\w$€£¥%°]+$")
NUM, UNIT, MEASURE, NAME, LETTER = range(5)  # a letter is a unit only after a number
_ODD = 0x9E3779B97F4A7C15
_PLACEHOLDER = np.array([0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x6A09E667F3BCC909, 0xBB67AE8584CAA73B, 0], dtype=np.uint64)


def _canonical(raw: str) -> tuple[str, int, bool, bool]:
    """Lower-cased word, kind of placeholder (-1: none), capitalised, ends a sentence."""
    ends = raw[-1] in ".!?:" or raw[-2:] in (".”", '."', "?”", '?"')
    word = raw if raw.isalpha() else raw[:-1] if raw[:-1].isalpha() and raw[-1] in ",.;:!?" else _OUTER.sub("", raw)
    low = word.lower()
    if low in UNITS:
        return low, LETTER if len(low) == 1 and low.isalpha() else UNIT, False, ends
    if not word.isalpha() and (number := _NUMBER.fullmatch(word)):
        return low, MEASURE if number[1].strip("+-") or number[3].lower() in UNITS and number[3] else NUM, False, ends
    return low.strip("+-"), -1, len(word) > 1 and word[0].isupper(), ends


class Words(dict):
    """White-space separated word to its row in arrays of code, code without placeholder, kind, capital and end of sentence."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[tuple[int, int, int, bool, bool]] = []  # rows that are not in the arrays yet
        self.used = 0
        self.arrays = [np.zeros(1 << 12, kind) for kind in (np.uint64, np.uint64, np.int8, bool, bool)]

    def __missing__(self, raw: str) -> int:
        low, kind, capital, ends = _canonical(raw)
        plain = xxhash.xxh64_intdigest(low, 1) if low else 0
        code = int(_PLACEHOLDER[kind]) if 0 <= kind < LETTER else plain
        self[raw] = at = self.used + len(self.fresh)
        self.fresh.append((code, plain, kind, capital, ends))
        return at

    def columns(self, at: np.ndarray) -> list[np.ndarray]:
        if self.fresh:
            end = self.used + len(self.fresh)
            if end > len(self.arrays[0]):
                self.arrays = [np.resize(a, 2 * end) for a in self.arrays]
            for array, values in zip(self.arrays, zip(*self.fresh, strict=True), strict=True):
                array[self.used : end] = np.array(values, dtype=array.dtype)
            self.used, self.fresh = end, []
        return [a[at] for a in self.arrays]


@lru_cache(maxsize=1)
def _memo() -> Words:
    """The words that this worker has seen."""
    return Words()


def _hashes(code: np.ndarray, size: int, reading: int) -> np.ndarray:
    """Hash of every run of ``size`` codes."""
    n = len(code) - size + 1
    mixed = np.full(n, size * 4 + reading, dtype=np.uint64)
    for i in range(size):
        mixed = (mixed ^ code[i : i + n]) * np.uint64(_ODD)
        mixed ^= mixed >> np.uint64(29)
    return mixed


PLAIN, NAMED, EXACT = range(3)  # readings: without and with placeholders for names, without any


def windows(texts: list[str], window: int, literals: int, accept, sizes: list[int] | None = None):
    """Canonical windows of texts for which ``accept(hashes)`` is true.

    Rows ``(number of the text, named, hash, pos, size, words, slots, offsets)``; ``pos`` counts
    the ``words`` canonical words of the text.  A text with fewer words than a
    window is one window of its own; with ``sizes``, all windows of these sizes are taken instead.
    """
    memo = _memo()
    if len(memo) > MEMO:
        memo.__init__()
        memo.clear()
    raw: list[str] = []
    counts = []
    for text in texts:
        words = text.split()
        raw += words
        counts.append(len(words))
    if not raw:
        return []
    at = np.fromiter(map(memo.__getitem__, raw), dtype=np.int64, count=len(raw))
    code, exact, kind, capital, ends = memo.columns(at)
    text_of = np.repeat(np.arange(len(texts)), counts)
    same = np.r_[False, text_of[1:] == text_of[:-1]]
    name = capital & same & ~np.r_[True, ends[:-1]]
    # a unit after a number is one slot with it; words of punctuation only are left out
    joined = same & np.r_[False, (kind[:-1] == NUM) & ((kind[1:] == UNIT) | (kind[1:] == LETTER))]
    measure = np.r_[joined[1:], False]
    code, kind = np.where(measure, _PLACEHOLDER[MEASURE], code), np.where(measure, np.int8(MEASURE), np.where(kind == LETTER, np.int8(-1), kind))
    exact = np.where(measure, exact * np.uint64(_ODD) + np.r_[exact[1:], exact[:1]], exact)
    left = np.flatnonzero((code != 0) & ~joined)
    code, exact, kind, text_of = code[left], exact[left], kind[left], text_of[left]
    name = name[left] & (kind < 0)
    n_words = np.bincount(text_of, minlength=len(texts))
    begin = np.r_[0, np.cumsum(n_words)]
    found = []

    def look(first: int, last: int, size: int) -> None:
        """Windows of ``size`` words inside words ``first`` to ``last`` that lie in one text."""
        own = text_of[first:last]
        whole = own[: len(own) - size + 1] == own[size - 1 :]
        for reading in (PLAIN, NAMED, EXACT):
            c, k = code[first:last], kind[first:last]
            if reading == NAMED:
                mask = name[first:last]
                if not mask.any():
                    continue
                c, k = np.where(mask, _PLACEHOLDER[NAME], c), np.where(mask, np.int8(NAME), k)
            literal = np.r_[0, np.cumsum(k < 0)]
            enough = literal[size:] - literal[:-size] >= min(literals, size)
            ok = whole & (~enough if reading == EXACT else enough)
            if reading == NAMED:  # a window without names is the same in both readings
                names = np.r_[0, np.cumsum(k == NAME)]
                ok &= names[size:] > names[:-size]
            elif reading == EXACT:
                if not ok.any():
                    continue
                c, k = exact[first:last], np.full(last - first, -1, dtype=np.int8)
            hashes = _hashes(c, size, reading)
            named = reading == NAMED
            chosen = np.flatnonzero(ok)
            for i in chosen[accept(hashes[chosen])]:
                text = int(own[i])
                slots, offsets = [], []
                for w in range(i, i + size):
                    if k[w] >= 0:
                        j = int(left[first + w])
                        value = f"{raw[j]} {raw[j + 1]}" if k[w] == MEASURE and j + 1 < len(joined) and joined[j + 1] else raw[j]
                        slots.append(f"{k[w]}:{_OUTER.sub('', value).lower()}")
                        offsets.append(w - int(i))
                found.append((text, named, int(hashes[i].view(np.int64)), first + int(i) - int(begin[text]), size, int(n_words[text]), slots, offsets))

    if len(left) >= window:
        look(0, len(left), window)
    for size in sizes or []:
        if len(left) >= size:
            look(0, len(left), size)
    for text in np.flatnonzero((n_words > 0) & (n_words < window)) if sizes is None else []:
        look(int(begin[text]), int(begin[text + 1]), int(n_words[text]))
    return found


_FIELDS = "key long, mark long, named boolean, hash long, pos int, size int, words int, slots array<string>, offsets array<int>"


def _find(window: int, literals: int, bits, sizes: list[int] | None = None):
    """Task function: rows (key, mark, UTF-8 text) to its windows; with ``bits``, those the filter lets through."""
    schema = pa.schema([("key", pa.int64()), ("mark", pa.int64()), ("named", pa.bool_()), ("hash", pa.int64()), ("pos", pa.int32()), ("size", pa.int32()), ("words", pa.int32()), ("slots", pa.list_(pa.string())), ("offsets", pa.list_(pa.int32()))])

    def accept(hashes: np.ndarray) -> np.ndarray:
        return np.ones(len(hashes), dtype=bool) if bits is None else in_filter(hashes, bits.value)

    def run(batches):
        for batch in batches:
            part, keys, size = [], [], 0
            ends = batch.num_rows - 1
            for i, (key, mark, data) in enumerate(zip(*batch.columns[:3], strict=True)):
                part.append(data.as_py().decode())
                keys.append((key.as_py(), mark.as_py()))
                size += len(part[-1])
                if size < PART_CHARS and i < ends:
                    continue
                if rows := windows(part, window, literals, accept, sizes):
                    rows = [(*keys[row[0]], *row[1:]) for row in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                part, keys, size = [], [], 0

    return run


def _places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    bit = hashes % np.uint64(words * 64), (hashes >> np.uint64(21)) % np.uint64(words * 64)
    return tuple(b.astype(np.int64) for b in bit)


def in_filter(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), dtype=bool)
    for bit in _places(hashes, len(table)):
        found &= (table[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found


def build_filter(windows_: DataFrame, words: int = BLOOM_WORDS) -> np.ndarray:
    """Two bits per window hash; the bits are joined by the executors, and the result has a fixed size."""

    def bits(batches):
        table = np.zeros(words, dtype=np.uint64)
        for batch in batches:
            for bit in _places(batch.column(0).to_numpy().view(np.uint64), words):
                np.bitwise_or.at(table, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].view(np.int64))], names=["word", "bits"])

    table = np.zeros(words, dtype=np.int64)
    for row in windows_.select("hash").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        table[row["word"]] = row["bits"]
    return table.view(np.uint64)


def consistent(hits: list[tuple[int, int, list[str], list[str], list[int]]]) -> tuple[list[int], bool]:
    """Item words in consistent windows of one alignment, and whether a slot of them has another value.

    A window has its place in the item, its size, the values of its slots in the
    item and in the document, and where in the window they are.
    """
    slots = {(pos + at, a, b) for pos, _, ours, theirs, offsets in hits for a, b, at in zip(ours, theirs, offsets, strict=True)}
    votes: dict[str, dict[str, int]] = {}
    for _, a, b in sorted(slots):
        own = votes.setdefault(a, {})
        own[b] = own.get(b, 0) + 1
    stands = {a: max(own, key=own.__getitem__) for a, own in votes.items()}
    covered, changed = set(), False
    for pos, size, ours, theirs, _ in hits:
        if all(b in (a, stands[a]) for a, b in zip(ours, theirs, strict=True)):
            covered.update(range(pos, pos + size))
            changed |= ours != theirs
    return sorted(covered), changed


def longest_run(places: list[int]) -> int:
    """Length of the longest row of consecutive numbers in ascending ones."""
    if not places:
        return 0
    breaks = np.flatnonzero(np.diff(places) != 1) + 1
    return int(np.diff(np.r_[0, breaks, len(places)]).max())


#: A document and an item: rows that share an id, or have none, are told apart by their text.
PAIR = ["doc_id", "doc_mark", "item_id", "item_mark"]


def _keyed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, mark, text``: the mark is a hash of the text."""
    text = utf8(text_col)
    return rows.select(F.col(id_col).cast("long").alias("key"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _covered(batches):
    """Task function: alignments with their windows to the item words that are covered, and the longest run of them."""
    for batch in batches:
        found = [consistent([tuple(h.values()) for h in hits.as_py()]) for hits in batch.column(5)]
        places, changed = ([f[i] for f in found] for i in range(2))
        runs = [longest_run(p) for p in places]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array(places, pa.list_(pa.int32())), pa.array(runs, pa.int32()), pa.array(changed, pa.bool_())], names=[*PAIR, "words", "places", "run", "changed"]
        )


def _contaminated(docs, benchmark, window, coverage, literals, id_col, text_col, item_col, item_text_col, run) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    items = saved(_keyed(benchmark, item_col, item_text_col).mapInArrow(_find(window, literals, None), _FIELDS), "items")
    bits = spark.sparkContext.broadcast(build_filter(items))
    sizes = sorted(r["size"] for r in items.where(F.col("size") < window).select("size").distinct().collect())
    found = _keyed(docs, id_col, text_col).mapInArrow(_find(window, literals, bits, sizes), _FIELDS)
    named = [F.col("key").alias("item_id"), F.col("mark").alias("item_mark")]
    asked = items.select(*named, "named", "hash", F.col("pos").alias("item_pos"), "size", "words", F.col("slots").alias("item_slots"), "offsets").distinct()
    placed = found.select(F.col("key").alias("doc_id"), F.col("mark").alias("doc_mark"), "named", "hash", "pos", "size", "slots")
    hits = placed.join(asked, ["hash", "named", "size"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    # one alignment is one shift; it has at most as many windows as the item
    window_ = F.struct("item_pos", "size", F.col("item_slots").alias("ours"), F.col("slots").alias("theirs"), "offsets")
    runs = hits.groupBy(*PAIR, "words", "named", "shift").agg(F.collect_set(window_).alias("hits"))
    kinds = ", ".join(f"{name} long" for name in PAIR)
    placed = runs.select(*PAIR, "words", "hits").mapInArrow(_covered, f"{kinds}, words int, places array<int>, run int, changed boolean")
    per_item = placed.where(F.size("places") > 0).groupBy(*PAIR, "words").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("covered"), F.max("run").alias("run"), F.bool_or("changed").alias("slots_changed")
    )
    enough = (F.col("covered") >= F.lit(coverage) * F.col("words")) | (F.col("run") >= run)
    return per_item.where(enough)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    coverage: float = COVERAGE,
    literals: int = LITERALS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    run: int = RUN,
) -> DataFrame:
    """``doc_id, item_id, covered, n_words, slots_changed`` of the items that documents hold.

    ``covered`` of the item's ``n_words`` canonical words lie in consistent
    windows, or ``run`` in a row; ``slots_changed`` tells whether a slot has another value there.
    Rows that share an id, or have none, are documents (and items) of their own
    unless their texts are equal.
    """
    found = _contaminated(docs, benchmark, window, coverage, literals, id_col, text_col, item_col, item_text_col, run)
    return found.select("doc_id", "item_id", "covered", F.col("words").alias("n_words"), "slots_changed")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    coverage: float = COVERAGE,
    literals: int = LITERALS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    run: int = RUN,
) -> DataFrame:
    """Documents that hold no item; columns and all other rows stay, also those that share an id with one that goes."""
    found = _contaminated(docs, benchmark, window, coverage, literals, id_col, text_col, item_col, item_text_col, run)
    gone = found.select(F.col("doc_id").alias("__gone_id"), F.col("doc_mark").alias("__gone_mark")).distinct()
    same = docs[id_col].cast("long").eqNullSafe(gone["__gone_id"]) & (F.xxhash64(utf8(docs[text_col])) == gone["__gone_mark"])
    return docs.join(gone, same, "left_anti")
