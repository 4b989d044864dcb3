"""Operator 10: homomorphic multiset hash of a text's paragraphs, in DataFrame operations only.

A text is the multiset of its paragraphs (line breaks and sentence ends divide
it, blank pieces do not count).  Its state, an array of longs, is a sum of
vectors hashed from them:

* their number;
* eight lanes modulo 2^32, from four 64-bit hashes of each paragraph: equal
  multisets have equal sums, others with negligible probability do too;
* 252 lanes modulo 2^8, seven to a word; each paragraph adds an odd number, drawn
  from its hash, to one of them;
* six times as many lanes again, of which level j has those paragraphs only whose hash
  ends in 2 j zero bits, one in 4^j.

States add and subtract lane by lane, so paragraphs can be inserted and deleted
in any order without reading the rest (``add``, ``remove``).  The number of lanes
that are not zero estimates how many different paragraphs a state has, and that
of lanes in which two states differ how many paragraphs do, on the first level where
at most ``FULL`` lanes are; from these follows
the ``likeness``: the estimated Jaccard similarity, 1 for equal states.

Defined results: a null text is empty; texts without paragraphs are equal to
each other, with likeness 1 between them and 0 to others; equal texts have
equal fingerprints.  ``edited_table`` orders rows by id, null ids first and equal
ids by text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARAGRAPH_END = r"[\r\n]+|(?<=[.!?])[ \t]+"
HASHES = 4
SUMS = 2 * HASHES
LOW = (1 << 32) - 1
WORDS = 36
GROUP = 6  # words that are filled together
PER_WORD = 7  # lanes of a byte; the eighth stays free, so that no sum overflows
LANES = PER_WORD * WORDS
LEVELS = 7  # up to a million different paragraphs
FULL = 200  # lanes of a level that may be used
ALL = (1 << 8 * PER_WORD) - 1
HIGH = sum(0x80 << 8 * i for i in range(PER_WORD))  # the top bit of each lane
REST = ALL ^ HIGH
CHUNK_ROWS = 1000  # documents that are ordered together
MAX_CHUNKS = 1 << 16  # bounds the list of chunk starts that the driver sees


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END), lambda p: F.trim(p) != "")


def with_state(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """Add the state of a text column.

    The paragraphs and their hashes are columns on the way, so that each is
    computed once although every lane reads them.
    """
    return with_state_of(rows.withColumn(f"__parts_{name}", paragraphs(F.col(text_col))), f"__parts_{name}", name)


def _hashed(parts: str, seed: int) -> Column:
    return F.transform(parts, lambda p: F.xxhash64(F.lit(seed), p))


def with_state_of(rows: DataFrame, parts_col: str, name: str) -> DataFrame:
    """Add the state of an array of paragraphs, which is dropped."""
    hashes = [f"__hash{seed}_{name}" for seed in range(HASHES)]
    for seed, column in enumerate(hashes):
        rows = rows.withColumn(column, _hashed(parts_col, seed))
    places = [f"__places{level}_{name}" for level in range(LEVELS)]
    rows = rows.withColumn(places[0], F.transform(hashes[0], _place))

    def chosen(level: int) -> Column:
        return F.filter(places[0], lambda _, i: F.get(hashes[1], i).bitwiseAND(F.lit((1 << 2 * level) - 1)) == 0)

    for level, column in enumerate(places[1:], 1):
        rows = rows.withColumn(column, chosen(level))

    def lane(column: str, high: bool) -> Column:
        part = (lambda h: F.shiftrightunsigned(h, 32)) if high else (lambda h: h.bitwiseAND(F.lit(LOW)))
        return F.aggregate(column, F.lit(0).cast("long"), lambda total, h: (total + part(h)).bitwiseAND(F.lit(LOW)))

    def group(places_col: str, g: Column) -> Column:
        """Six words from the places that belong to them, picked out once and held in an array of one."""
        mine = F.array(F.filter(places_col, lambda at: F.shiftright(at, 59) == g))
        return F.transform(mine, lambda few: F.transform(F.sequence(F.lit(0), F.lit(GROUP - 1)), lambda i: word(few, i)))[0]

    def word(few: Column, i: Column) -> Column:
        return F.aggregate(F.filter(few, lambda at: _word_of(at) == i), F.lit(0).cast("long"), _add_lanes)

    number = F.array(F.size(parts_col).cast("long"))
    sums = F.array(*[lane(column, high) for column in hashes for high in (False, True)])
    none = F.array_repeat(F.lit(0).cast("long"), WORDS)

    def words_of(column: str) -> Column:
        lanes = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(WORDS // GROUP - 1)), lambda g: group(column, g)))
        return F.when(F.size(column) == 0, none).otherwise(lanes)

    return rows.withColumn(name, F.concat(number, sums, *map(words_of, places))).drop(parts_col, *places, *hashes)


_FACTORS = [1 << 8 * i for i in range(PER_WORD)]


def _place(h: Column) -> Column:
    """Group of a paragraph's lane above bit 59 and its word in the group above bit 56; below, the odd number at the lane's place."""
    lane = F.pmod(h, F.lit(LANES))
    odd = F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(255)).bitwiseOR(F.lit(1))
    factor = F.element_at(F.lit(_FACTORS).cast("array<bigint>"), (lane % PER_WORD).cast("int") + 1)
    word = F.floor(lane / PER_WORD)
    return F.shiftleft(F.floor(word / GROUP), 59) + F.shiftleft(word % GROUP, 56) + odd * factor


def _word_of(place: Column) -> Column:
    """Word of a place within its group."""
    return F.shiftright(place, 56).bitwiseAND(F.lit(7))


def _add_lanes(a: Column, b: Column) -> Column:
    """Sum of bytes modulo 2^8 each; whatever stands above the lanes of ``b`` is left out."""
    low = a.bitwiseAND(F.lit(REST)) + b.bitwiseAND(F.lit(REST))
    return low.bitwiseXOR(a.bitwiseXOR(b).bitwiseAND(F.lit(HIGH)))


def _subtract_lanes(a: Column, b: Column) -> Column:
    low = a.bitwiseOR(F.lit(HIGH)) - b.bitwiseAND(F.lit(REST))
    return low.bitwiseXOR(a.bitwiseXOR(b).bitwiseXOR(F.lit(ALL)).bitwiseAND(F.lit(HIGH)))


def _used_lanes(w: Column) -> Column:
    """Number of bytes of a word that are not zero."""
    return F.bit_count((w.bitwiseAND(F.lit(REST)) + F.lit(REST)).bitwiseOR(w).bitwiseAND(F.lit(HIGH)))


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    def part(start: int, size: int, merge) -> Column:
        return F.zip_with(F.slice(a, start, size), F.slice(b, start, size), merge)

    number = part(1, 1, lambda x, y: x + sign * y)
    sums = part(2, SUMS, lambda x, y: (x + sign * y).bitwiseAND(F.lit(LOW)))
    return F.concat(number, sums, part(2 + SUMS, WORDS * LEVELS, _add_lanes if sign > 0 else _subtract_lanes))


def add(a: Column, b: Column) -> Column:
    """State of the paragraphs of both."""
    return _lanewise(a, b, 1)


def remove(a: Column, b: Column) -> Column:
    """State of the paragraphs of ``a`` without those of ``b``, which it must hold."""
    return _lanewise(a, b, -1)


def fingerprint(s: Column) -> Column:
    """Number, sums and lanes of all paragraphs as hexadecimal text."""
    return F.lower(F.array_join(F.transform(F.slice(s, 1, 1 + SUMS + WORDS), lambda x, i: F.lpad(F.hex(x), F.when(i <= SUMS, 8).otherwise(2 * PER_WORD), F.lit("0"))), ""))


def _used(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda t, w: t + _used_lanes(w))


def _kinds(used: Column) -> Column:
    """Estimated number of different paragraphs, from the number of lanes that are used (linear counting)."""
    return -LANES * F.log(1 - F.least(used, F.lit(LANES - 0.5)) / LANES)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two multisets, from 0 to 1."""

    def used(level: Column) -> Column:
        x, y = (F.slice(s, F.lit(2 + SUMS) + level * WORDS, F.lit(WORDS)) for s in (a, b))
        return F.array(_used(x), _used(y), _used(F.zip_with(x, y, lambda v, w: v.bitwiseXOR(w))))

    def ratio(u: Column) -> Column:
        # (both - differing) / (both + differing), from one evaluation of each
        both = _kinds(u[0]) + _kinds(u[1])
        return F.greatest(F.lit(0.0), F.lit(2.0) / (1 + F.coalesce(F.try_divide(_kinds(u[2]), both), F.lit(1.0))) - 1)

    # the first level that is not too full, or else the last; the levels after it are not looked at
    chosen = F.aggregate(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)),
        F.array().cast("array<int>"),
        lambda found, level: F.when((F.size(found) > 0) & (F.array_max(found) <= FULL), found).otherwise(used(level)),
    )
    estimate = F.transform(F.array(chosen), ratio)[0]
    return F.when(F.slice(a, 1, 1 + SUMS) == F.slice(b, 1, 1 + SUMS), 1.0).otherwise(estimate)


def _chunk_starts(ids: DataFrame) -> tuple[list[int], bool]:
    """First ids of chunks of about equal numbers of rows; whether there are null ids.  At most ``MAX_CHUNKS`` ids."""
    n, filled, least = ids.agg(F.count(F.lit(1)), F.count("doc_id"), F.min("doc_id")).first()
    chunks = max(1, min(MAX_CHUNKS, math.ceil(filled / CHUNK_ROWS)))
    if not filled or chunks == 1:
        return [least or 0], n > filled
    shares = F.lit([i / chunks for i in range(1, chunks)])
    found = ids.agg(F.percentile_approx("doc_id", shares, 10 * max(1000, chunks))).first()[0]
    return sorted({least, *found}), n > filled


def _chunk_of(starts: list[int]) -> Column:
    """Number of the chunk of ``doc_id``: two short searches in constant lists."""
    group = max(1, math.isqrt(len(starts)))
    rows = [starts[i : i + group] for i in range(0, len(starts), group)]
    longs = lambda xs: f"cast(split('{','.join(map(str, xs))}', ',') as array<bigint>)"
    first = F.expr(longs([r[0] for r in rows]))
    which = F.size(F.filter(first, lambda b: b <= F.col("doc_id")))
    part = F.slice(F.expr(longs(starts)), (which - 1) * group + 1, F.lit(group))
    found = (which - 1) * group + F.size(F.filter(part, lambda b: b <= F.col("doc_id"))) - 1
    return F.when(F.col("doc_id").isNull(), 0).otherwise(found)


def edited_table(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness to each other and to the next text.

    The edited form ends with the first half of the next document in ascending
    id order (after the last one, the first).  Rows meet their successor in
    chunks of consecutive ids, to which the first row of the following chunk is
    added; so the text is shuffled once and no task orders the whole table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    starts, nulls = _chunk_starts(docs.select(F.col("doc_id").cast("long").alias("doc_id")))
    placed = rows.withColumn("chunk", _chunk_of(starts))
    at_start = F.array_contains(F.expr(f"cast(split('{','.join(map(str, starts))}', ',') as array<bigint>)"), F.col("doc_id"))
    leads = F.col("doc_id").isNull() | ((F.col("doc_id") == starts[0]) & F.lit(not nulls)) | (at_start & (F.col("chunk") > 0))
    # a chunk's first rows go to the chunk before as well; those of the whole table to the last one, behind its end
    home = F.struct(F.col("chunk").alias("chunk"), F.lit(True).alias("own"), F.lit(False).alias("wraps"))
    first = F.col("chunk") == 0
    guest = F.struct(F.when(first, F.lit(len(starts) - 1)).otherwise(F.col("chunk") - 1).alias("chunk"), F.lit(False).alias("own"), first.alias("wraps"))
    spread = placed.select("doc_id", "text", F.explode(F.when(F.coalesce(leads, F.lit(False)), F.array(home, guest)).otherwise(F.array(home))).alias("at"))
    chunks = spread.select("doc_id", "text", "at.*").repartition("chunk")
    chunks = with_state(chunks, "text", "state")
    order = Window.partitionBy("chunk").orderBy("wraps", F.asc_nulls_first("doc_id"), "text", F.desc("own"))
    following = chunks.withColumn("next_text", F.lead("text").over(order)).withColumn("next_state", F.lead("state").over(order)).where("own")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", "text"), F.lit(1), half))
    made = following.select("doc_id", n.cast("long").alias("n_chars"), "state", F.coalesce("next_state", "state").alias("next_state"), edited.alias("edited"))
    made = with_state(made, "edited", "edited_state")
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("state")).alias("fingerprint"),
        fingerprint(F.col("edited_state")).alias("edited_fingerprint"),
        likeness(F.col("state"), F.col("edited_state")).alias("near_edited"),
        likeness(F.col("state"), F.col("next_state")).alias("near_next"),
    )
