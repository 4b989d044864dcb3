"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length one and cut into two halves. Each half has a
codebook of centroids, trained on a bounded sample, and a row lies in the cell
of its two nearest centroids. A query walks the cells by ascending sum of its
two centroid distances, with a heap over the sorted halves, until the cells it
has passed hold the wanted share of all rows. The rows of these cells are
reranked by their cosine with the original vectors.

The share is measured when the codebooks are trained: neighbours of sample
rows are found by brute force among the sample, and the share is where the
walk reaches the target part of them. All rows are indexed, and a cell of any
size is dealt to as many tasks as its rows need.
"""

from __future__ import annotations

import heapq
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborframe.session import saved

from .vectors import block_count, block_rows, finite, matrix

#: Rows on which the codebooks are trained, and among which the share of cells is measured.
SAMPLE = 16_384
SAMPLE_BYTES = 64 << 20
#: Centroids of a half: one for each 32 sample rows, and this many at most.
CENTROIDS = 128
#: Part of the true neighbours that the walk has to reach in the sample.
TARGET = 0.97
#: A walk passes at least this number of rows, so that small tables are searched as a whole.
LEAST_ROWS = 2000
ROUNDS = 12
SEED = 71

#: Codebooks of the halves, the length of vectors, and the share of rows that a walk passes.
Index = namedtuple("Index", "halves width share")


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to length one; their largest component comes first to one, so that squares neither vanish nor overflow."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def squared_distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points * points).sum(axis=1)[:, None] - 2.0 * points @ centroids.T + (centroids * centroids).sum(axis=1)


def centroids_of(points: np.ndarray, number: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from seeded rows; one without rows stays where it is."""
    start = np.random.Generator(np.random.PCG64(SEED)).choice(len(points), number, replace=False)
    centroids = points[np.sort(start)].copy()
    for _ in range(ROUNDS):
        nearest = squared_distances(points, centroids).argmin(axis=1)
        order = np.argsort(nearest, kind="stable")
        present, starts, counts = np.unique(nearest[order], return_index=True, return_counts=True)
        centroids[present] = np.add.reduceat(points[order], starts, axis=0) / counts[:, None]
    return centroids


def cells_of(units: np.ndarray, halves) -> np.ndarray:
    cut = halves[0].shape[1]
    first, second = squared_distances(units[:, :cut], halves[0]), squared_distances(units[:, cut:], halves[1])
    return first.argmin(axis=1) * len(halves[1]) + second.argmin(axis=1)


def walk_cells(first: np.ndarray, second: np.ndarray, rows_in: np.ndarray, wanted: int) -> list[int]:
    """Cells that hold rows, by ascending summed distance, until ``wanted`` rows are passed.

    Pair (i, j) of the two sorted lists enters the heap when both (i - 1, j)
    and (i, j - 1) have left it; so the heap holds at most one pair per line.
    """
    by_first, by_second = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    a, b = first[by_first].tolist(), second[by_second].tolist()
    done = [0] * len(a)  # pairs of line i that have left the heap
    heap, passed, found, size = [(a[0] + b[0], 0, 0)], 0, [], len(b)
    while heap and passed < wanted:
        _, i, j = heapq.heappop(heap)
        cell = by_first[i] * size + by_second[j]
        if rows := rows_in[cell]:
            found.append(cell)
            passed += rows
        done[i] = j + 1
        if j + 1 < size and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
    return found


def train(sample: np.ndarray, width: int, centroids: int, k: int, target: float) -> Index:
    """Codebooks and the share of rows to pass, from sample vectors of length one."""
    number, cut = max(1, min(centroids, len(sample) // 32)), (width + 1) // 2
    halves = [centroids_of(np.ascontiguousarray(part), number) if part.shape[1] else np.zeros((1, 0)) for part in (sample[:, :cut], sample[:, cut:])]
    asked = sample[:: max(1, len(sample) // 400)]
    cells = cells_of(sample, halves)
    first, second = squared_distances(asked[:, :cut], halves[0]), squared_distances(asked[:, cut:], halves[1])
    cosines = asked @ sample.T
    shares = []
    for at in range(len(asked)):
        summed = first[at][cells // len(halves[1])] + second[at][cells % len(halves[1])]
        cosines[at, np.argmax(cosines[at])] = -2.0  # the row itself
        near = np.argsort(-cosines[at], kind="stable")[:k]
        shares += [(summed <= summed[one]).sum() / len(sample) for one in near]
    return Index(halves, width, float(np.quantile(shares, target)) if shares else 1.0)


def best(query: np.ndarray, own: int, ids: np.ndarray, units: np.ndarray, estimates: np.ndarray, k: int):
    """Ids and cosines of the first ``k`` of these rows other than the query's own.

    Products of a whole block may differ in their last bits between equal
    vectors, so all rows within their error of the k-th are scored again alone.
    """
    keep = ids != own
    ids, units, estimates = ids[keep], units[keep], estimates[keep]
    if len(ids) > k:
        near = estimates >= np.partition(estimates, -k)[-k] - 1e-12
        ids, units = ids[near], units[near]
    scores = (units * query).sum(axis=1)
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def reranker(width: int, k: int):
    def rerank(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [], [], []
        if left.num_rows and right.num_rows:
            order = np.argsort(left["cell"].to_numpy(), kind="stable")
            cells, ids = left["cell"].to_numpy()[order], left["vec_id"].to_numpy()[order]
            units = unit(matrix(left["vector"], width)[order])
            starts = dict(zip(*np.unique(cells, return_index=True), strict=True))
            ends = dict(zip(*np.unique(cells[::-1], return_index=True), strict=True))
            span = {cell: np.arange(start, len(cells) - ends[cell]) for cell, start in starts.items()}
            queries = unit(matrix(right["vector"], width))
            for at, (key, own, passed) in enumerate(zip(right["row"].to_pylist(), right["vec_id"].to_pylist(), right["cells"].to_pylist(), strict=True)):
                here = [span[cell] for cell in passed if cell in span]
                if here:
                    rows = np.concatenate(here)
                    those = units[rows]
                    near, scores = best(queries[at], own, ids[rows], those, those @ queries[at], k)
                    for column, values in zip(found, ([key] * len(near), near.tolist(), scores.tolist()), strict=True):
                        column += values
        return pa.table({"row": pa.array(found[0], pa.int64()), "other_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    return rerank


def usable(frame: DataFrame) -> DataFrame:
    """Rows with an id and a finite vector that is not zero."""
    some = F.exists("embedding", lambda x: x != 0)
    return frame.where(F.col("vec_id").isNotNull() & finite("embedding") & some).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    )


def build(frame: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE, k: int = 5, target: float = TARGET) -> tuple[DataFrame, Index]:
    """Every usable row with its cell, written to the shared folder, and the index."""
    rows = saved(usable(frame).withColumn("row", F.monotonically_increasing_id()), "vectors")
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    bound = min(sample, max(32, SAMPLE_BYTES // (8 * max(1, width))))
    chosen = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, bound / max(1, count)))))
    points = matrix(pa.concat_tables([chosen.select("vector").limit(bound).toArrow()])["vector"], width) if count else np.zeros((0, 0))
    index = train(unit(points), width, centroids, k, target) if len(points) else Index([np.zeros((1, (width + 1) // 2)), np.zeros((1, width // 2))], width, 1.0)

    def assign(batches):
        for batch in batches:
            cells = cells_of(unit(matrix(batch.column("vector"), width)), index.halves) if batch.num_rows else np.zeros(0, np.int64)
            yield batch.append_column("cell", pa.array(cells.astype(np.int32)))

    return saved(rows.mapInArrow(assign, "vec_id long, vector array<double>, row long, cell int"), "index"), index


def groups_of(counts: dict[int, int], lines: int, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First group and number of groups of each centroid of the first half, so that a group holds about ``size`` rows."""
    rows = np.zeros(lines, np.int64)
    for cell_line, n in counts.items():
        rows[cell_line] = n
    start, parts, at, room = np.zeros(lines, np.int64), np.ones(lines, np.int64), 0, size
    for line in range(lines):
        if rows[line] > size:
            at += room < size
            start[line], parts[line], room = at, -(-rows[line] // size), size
            at += parts[line]
        else:
            if rows[line] > room:
                at, room = at + 1, size
            start[line], room = at, room - rows[line]
    return start, parts, int((start + parts).max())


def search(frame: DataFrame, query_every: int = 50, k: int = 5, centroids: int = CENTROIDS, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """The nearest rows found for each row whose id is divisible by ``query_every``: query_id, rank, vec_id, score.

    ``frame`` has ``vec_id`` and ``embedding``; other columns are ignored.
    Rows without id or vector, and vectors that are zero or hold a component
    that is null or not finite, take no part. Shorter vectors count as ending
    in zeros. Rows with the query's id are its own; other repeated rows are
    candidates each. Ties go to the smaller id. An empty table has no rows.
    """
    rows, index = build(frame, centroids, sample, k, target)
    spark, size = rows.sparkSession, block_rows(index.width)
    lines, second = len(index.halves[0]), len(index.halves[1])
    # One number per cell, of which there are at most centroids squared.
    per_cell = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    total = sum(per_cell.values())
    rows_in = np.zeros(lines * second, np.int64)
    for cell, n in per_cell.items():
        rows_in[cell] = n
    wanted = max(LEAST_ROWS, int(np.ceil(index.share * total)))
    per_line = {line: int(rows_in[line * second : (line + 1) * second].sum()) for line in range(lines)}
    start, parts, number = groups_of(per_line, lines, max(64, min(size, -(-total // 16))))

    cut = (index.width + 1) // 2
    given = spark.sparkContext.broadcast((index.halves, rows_in.tolist()))

    def walk(batches):
        halves, held = given.value
        for batch in batches:
            if not batch.num_rows:
                continue
            units = unit(matrix(batch.column("vector"), index.width))
            first, second_half = squared_distances(units[:, :cut], halves[0]), squared_distances(units[:, cut:], halves[1])
            at, groups, cells = [], [], []
            for row in range(len(units)):
                passed = np.array(walk_cells(first[row], second_half[row], held, wanted), np.int64)
                of_line = passed // second
                for group in np.unique(np.concatenate([start[of_line] + part for part in range(int(parts[of_line].max(initial=1)))])) if len(passed) else []:
                    here = passed[(start[of_line] <= group) & (group < start[of_line] + parts[of_line])]
                    if len(here):
                        at.append(row)
                        groups.append(int(group))
                        cells.append(here.astype(np.int32))
            out = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [out.column("row"), out.column("vec_id"), out.column("vector"), pa.array(groups, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], ["row", "vec_id", "vector", "group", "cells"]
            )

    asked = saved(rows.where(F.col("vec_id") % query_every == 0).groupBy("vec_id", "vector").agg(F.min("row").alias("row")), "asked")
    blocks = block_count(asked.count(), size)
    walked = asked.repartition(max(1, min(200, blocks * 16)), "row").select("row", "vec_id", "vector").mapInArrow(walk, "row long, vec_id long, vector array<double>, group int, cells array<int>")
    of_line = F.floor(F.col("cell") / second).cast("int") + 1
    group = F.element_at(F.array(*[F.lit(int(x)) for x in start]), of_line) + F.col("row") % F.element_at(F.array(*[F.lit(int(x)) for x in parts]), of_line)
    left = rows.select("row", "vec_id", "vector", "cell", group.cast("long").alias("group"))
    # A query goes only to the groups whose cells it passed.
    line = F.pmod(F.hash("row"), F.lit(blocks))
    table = left.withColumn("__line", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("__cell", F.col("group") * blocks + F.col("__line")).drop("__line", "group")
    queries = walked.withColumn("__cell", F.col("group").cast("long") * blocks + line).drop("group")
    found = table.groupBy("__cell").cogroup(queries.groupBy("__cell")).applyInArrow(reranker(index.width, k), "row long, other_id long, score double")
    first = Window.partitionBy("row").orderBy(F.desc("score"), "other_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return ranked.join(asked.select("row", F.col("vec_id").alias("query_id")), "row").select("query_id", "rank", F.col("other_id").alias("vec_id"), "score")
