"""Rows by their place in id order, found from counts of id ranges.

Positions are never given to all rows. The ids are counted in ranges (combined
map-side), the ranges that hold the wanted positions are counted again in finer
ones, and only the last ones are read, by a condition on ``_id_x`` that reaches
the scan; inside them the rows are ranked. Rows that repeat an id stand side by
side, in the order of their plain columns; rows without an id have no position.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import namedtuple
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Every count splits a range into at most 2**10 parts; ranges with more rows than RANKED are split again.
SPLIT_BITS, RANKED = 10, 1 << 13
#: A slice with a step counts the ids in at most 2 * 2**STEP_BITS ranges.
STEP_BITS = 15
#: Up to this number of ranges are written out in a condition; beyond it, their hull.
CONDITIONS = 32

#: Ids from ``low`` to ``high``, the rows with smaller ids, and the rows in it.
Bucket = namedtuple("Bucket", "low high before rows")


class IdRanges:
    """Counts of a table's ids by aligned ranges of 2**shift ids."""

    def __init__(self, table: DataFrame):
        self.table, self.id = table, F.col("_id_x").cast("long")
        self.low, self.high, self.rows = table.agg(F.min(self.id), F.max(self.id), F.count("_id_x")).first()
        ids = (self.low, self.high) if self.rows else (0, 0)
        self.bits = 64 if ids[0] < 0 <= ids[1] else (ids[0] ^ ids[1]).bit_length()  # ids differ in the last bits only

    def key(self, shift: int) -> Column:
        return F.shiftright(self.id, shift)

    def within(self, buckets: Sequence[Bucket]) -> Column:
        """A condition on the ids that a scan understands."""
        if len(buckets) > CONDITIONS:
            return F.col("_id_x").between(buckets[0].low, buckets[-1].high)
        return reduce(or_, [F.col("_id_x").between(b.low, b.high) for b in buckets])

    def count(self, buckets: Sequence[Bucket], shift: int) -> list[Bucket]:
        """The parts of these ranges that hold rows, in order."""
        counted = self.table.where(self.within(buckets)).groupBy(self.key(shift).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        parts, at, before = [], 0, None
        for key, n in sorted((r["key"], r["n"]) for r in counted.collect()):  # at most 2**SPLIT_BITS for each range
            low = key << shift
            while low > buckets[at].high:
                at, before = at + 1, None
            if low + (1 << shift) <= buckets[at].low:
                continue  # between two ranges, read because of the hull
            before = buckets[at].before if before is None else before
            parts.append(Bucket(low, low + (1 << shift) - 1, before, n))
            before += n
        return parts

    def holding(self, places: Sequence[int]) -> tuple[list[Bucket], int]:
        """The ranges that hold these ascending positions, each of few rows or of a single id, and their shift."""
        buckets, shift = [Bucket(self.low, self.high, 0, self.rows)], self.bits
        while shift == 64 or shift and any(b.rows > RANKED for b in buckets):
            shift = max(0, shift - SPLIT_BITS)
            parts = self.count(buckets, shift)
            starts = [p.before for p in parts]
            buckets = [parts[i] for i in sorted({bisect_right(starts, place) - 1 for place in places})]
        return buckets, shift

    def ranked(self, condition: Column, shift: int) -> DataFrame:
        """Rows under a condition with their ``_key`` and ``_rank`` (from 0) inside the range."""
        rows = self.table.where(condition).withColumn("_key", self.key(shift))
        return rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy(*order(self.table))) - 1)


def order(table: DataFrame) -> list[str]:
    """Id order; rows of one id by their plain columns."""
    kinds = (T.StringType, T.NumericType, T.BooleanType)
    return ["_id_x", *[f"`{f.name}`" for f in table.schema if isinstance(f.dataType, kinds) and f.name != "_id_x"]]


def at(table: DataFrame, indices: Sequence[int]) -> DataFrame:
    """Rows at the given positions, next to ``pos``, their place in the list; negative positions count from the end."""
    ranges = IdRanges(table)
    for i in indices:
        if not -ranges.rows <= i < ranges.rows:
            raise IndexError(i)
    places = [int(i) % ranges.rows for i in indices]
    if not places:
        return table.limit(0).withColumn("pos", F.lit(0).cast("long"))
    buckets, shift = ranges.holding(sorted(set(places)))
    starts, wanted = [b.before for b in buckets], []
    for pos, place in enumerate(places):
        bucket = buckets[bisect_right(starts, place) - 1]
        wanted.append((pos, bucket.low >> shift, place - bucket.before))
    rows = ranges.ranked(ranges.within(buckets), shift)
    if len(wanted) == 1:
        found = rows.where((F.col("_key") == wanted[0][1]) & (F.col("_rank") == wanted[0][2]))
        return found.withColumn("pos", F.lit(0).cast("long")).drop("_key", "_rank")
    listed = table.sparkSession.createDataFrame(wanted, "pos long, _key long, _rank int")
    return rows.join(F.broadcast(listed), ["_key", "_rank"]).drop("_key", "_rank").orderBy("pos")  # the caller's own list


def span(table: DataFrame, first: int, last: int | None) -> DataFrame:
    """Rows from position ``first`` to ``last``, both included, in no order; no ``last`` means to the end."""
    if first <= 0 and last is None:
        return table.where(F.col("_id_x").isNotNull())
    ranges = IdRanges(table)
    last = ranges.rows - 1 if last is None else min(last, ranges.rows - 1)
    first = max(first, 0)
    if last < first:
        return table.limit(0)
    buckets, shift = ranges.holding(sorted({first, last}))
    head, tail = buckets[0], buckets[-1]
    edges = ranges.ranked(ranges.within(sorted({head, tail})), shift)
    of_head, of_tail = (F.col("_key") == b.low >> shift for b in (head, tail))
    after, until = F.col("_rank") >= first - head.before, F.col("_rank") <= last - tail.before
    rows = edges.where((~of_head | after) & (~of_tail | until)).select(*[F.col(f"`{c}`") for c in table.columns])
    if tail.before == head.before + head.rows or head == tail:
        return rows
    return rows.unionByName(table.where((F.col("_id_x") > head.high) & (F.col("_id_x") < tail.low)))


def sliced(table: DataFrame, start: int | None, stop: int | None, step: int | None) -> DataFrame:
    """Rows of a Python slice, in slice order."""
    ranges = IdRanges(table)
    taken = range(*slice(start, stop, step).indices(ranges.rows))
    if not taken:
        return table.limit(0)
    first, last = min(taken[0], taken[-1]), max(taken[0], taken[-1])
    if abs(taken.step) == 1:
        rows = span(table, first, last)
    else:
        shift = max(0, ranges.bits - STEP_BITS)
        parts = ranges.count([Bucket(ranges.low, ranges.high, 0, ranges.rows)], shift) if ranges.bits else [Bucket(ranges.low, ranges.high, 0, ranges.rows)]
        parts = [p for p in parts if p.before <= last and p.before + p.rows > first]
        offsets = table.sparkSession.createDataFrame([(p.low >> shift, p.before) for p in parts], "_key long, _before long")
        ranked = ranges.ranked(F.col("_id_x").between(parts[0].low, parts[-1].high), shift).join(F.broadcast(offsets), "_key")  # one row per range
        place = F.col("_before") + F.col("_rank")
        hit = place.between(first, last) & ((place - first) % abs(taken.step) == 0)
        rows = ranked.where(hit).select(*[F.col(f"`{c}`") for c in table.columns])
    ordered = [F.col(c).asc() if taken.step > 0 else F.col(c).desc() for c in order(table)]
    return rows.orderBy(*ordered)
