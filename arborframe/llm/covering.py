"""Operator 9: SimHash fingerprints linked by covering locality-sensitive hashing.

A fingerprint has one bit per position: 1 if more than half of the shingle
hashes have it.  Two fingerprints are linked if they differ in at most
``radius`` bits.  Every bit position gets a nonzero vector of radius + 1 bits;
the mask of a nonzero vector v keeps the positions whose vector has an odd
product with v.  For up to ``radius`` differing positions some v is orthogonal
to all of their vectors, so that mask hides every difference: each pair within
the radius shares a masked value in at least one of the 2^(radius+1) - 1 tables.

Only distinct fingerprints are hashed.  A bucket is read as a sorted stream; its
links are found by a search that compares each member only with those that are
not yet reached, and leaves as a spanning forest (at most one edge per member).
Buckets beyond ``BUCKET_ROWS`` are covered again by a second family of masks,
whose buckets keep more bits; the guarantee holds at every level.

Defined results: a null or blank text has fingerprint 0 and is linked like any
other; equal rows have equal fingerprints; a null id takes part but is never
the smallest id of its component (null if all ids are null); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .common import keep_ids, utf8
from .components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
BITS = 64
BUCKET_ROWS = 20_000  # members that one task compares; larger buckets are covered again
LEVELS = 3


def simhash(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text given as UTF-8 bytes, as an unsigned integer."""
    words = data.lower().split()  # on bytes: only A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash_of(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    hashes = np.array([hash_of(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 20_000):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[i : i + 20_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(shingle: int = SHINGLE, seed: int = SEED):
    """Column function: UTF-8 bytes to the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def of(data: pa.Array) -> pa.Array:
        found = np.fromiter((simhash(x.as_py() or b"", shingle, seed) for x in data), dtype=np.uint64, count=len(data))
        return pa.array(found.view(np.int64))

    return of


def covering_masks(radius: int, seed: int) -> np.ndarray:
    """2^(radius+1) - 1 masks of 64 bits; every set of ``radius`` positions is outside one of them."""
    size = 1 << (radius + 1)
    rng = np.random.default_rng(seed)
    vectors = rng.permutation(np.resize(np.arange(1, size), BITS))  # balanced, none zero
    masks = []
    for v in range(1, size):
        odd = np.bitwise_count(vectors & v) & 1
        masks.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")[0])
    return np.array(masks, dtype=np.uint64)


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints; edges (smaller, larger) as signed longs."""
    left = np.sort(members)
    edges = []
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            if near.any():
                reached = left[near]
                left = left[~near]
                queue += list(reached)
                edges.append((root, reached))
    return [(int(a), int(b)) for a, bs in edges for b in bs]


def _bucket_edges(radius: int, limit: int):
    """Task function: rows (bucket, fp) sorted by bucket to edges and, from large buckets, the rows to cover again."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64())])

    def emit(a, b, bucket):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, bucket)], schema=schema)

    def solved(buckets, fps):
        """Edges of complete buckets."""
        first = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        sizes = np.diff(np.r_[first, len(buckets)])
        pairs = first[sizes == 2]
        x, y = fps[pairs], fps[pairs + 1]
        near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
        found = [np.stack([np.minimum(x, y)[near], np.maximum(x, y)[near]])]
        for at, n in zip(first[sizes > 2], sizes[sizes > 2], strict=True):
            if edges := _forest(np.unique(fps[at : at + n]).view(np.uint64), radius):
                signed = np.array(edges, dtype=np.uint64).view(np.int64).T
                found.append(np.stack([signed.min(axis=0), signed.max(axis=0)]))
        edges = np.concatenate(found, axis=1)
        edges = edges[:, edges[0] != edges[1]]
        return emit(edges[0], edges[1], np.full(edges.shape[1], 0)) if edges.shape[1] else None

    def run(batches):
        held_b, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        spilling = None  # the large bucket that is being passed on
        for batch in batches:
            held_b = np.r_[held_b, batch.column(0).to_numpy()]
            held_f = np.r_[held_f, batch.column(1).to_numpy()]
            if not len(held_b):
                continue
            if spilling is not None:
                n = int(np.searchsorted(held_b != spilling, True)) if held_b[-1] != spilling else len(held_b)
                if n:
                    yield emit(held_f[:n], held_f[:n], held_b[:n])
                    held_b, held_f = held_b[n:], held_f[n:]
                if not len(held_b):
                    continue
                spilling = None
            last = int(np.searchsorted(held_b, held_b[-1]))  # start of the bucket that may go on
            first = np.flatnonzero(np.r_[True, held_b[1:last] != held_b[: last - 1]]) if last else np.zeros(0, int)
            sizes = np.diff(np.r_[first, last]) if last else first
            large = np.repeat(sizes > limit, sizes) if last else np.zeros(0, bool)
            if large.any():
                yield emit(held_f[:last][large], held_f[:last][large], held_b[:last][large])
            if last and (part := solved(held_b[:last][~large], held_f[:last][~large]) if (~large).any() else None) is not None:
                yield part
            held_b, held_f = held_b[last:], held_f[last:]
            if len(held_b) > limit:
                spilling = held_b[0]
                yield emit(held_f, held_f, held_b)
                held_b, held_f = held_b[:0], held_f[:0]
        if len(held_b) and (part := solved(held_b, held_f)) is not None:
            yield part

    return run


def links(fps: DataFrame, radius: int = RADIUS, limit: int = BUCKET_ROWS, levels: int = LEVELS) -> DataFrame:
    """Edges ``a, b`` (signed longs) that connect the distinct fingerprints ``fp`` as all pairs within the radius do."""
    rows = fps.select(F.lit(0).cast("long").alias("within"), "fp")
    found = None
    for level in range(levels):
        masks = [int(m) for m in covering_masks(radius, level).view(np.int64)]
        tables = F.explode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.struct(m.alias("mask"), F.col("fp").bitwiseAND(m).alias("value"))))
        # the hash of the bucket stands for it: a clash only adds comparisons
        keyed = rows.select("within", "fp", tables.alias("t")).select(F.xxhash64("within", "t.mask", "t.value").alias("bucket"), "fp")
        size = limit if level + 1 < levels else 1 << 62
        sorted_rows = keyed.repartition("bucket").sortWithinPartitions("bucket")
        out = saved(sorted_rows.mapInArrow(_bucket_edges(radius, size), "a long, b long, bucket long"), "simhash-links")
        edges = out.where(F.col("a") != F.col("b")).select("a", "b").distinct()
        found = edges if found is None else found.unionByName(edges).distinct()
        rows = out.where(F.col("a") == F.col("b")).select(F.col("bucket").alias("within"), F.col("a").alias("fp"))
        if rows.isEmpty():
            break
    return found


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    prints = saved(docs.select(F.col(id_col).alias("doc_id"), fingerprint(shingle, seed)(utf8(text_col)).alias("fp")), "simhash")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "simhash-distinct")
    members = components(links(distinct, radius))  # node, root; only linked fingerprints
    labelled = distinct.join(members, distinct["fp"] == members["node"], "left").select("fp", "smallest", F.coalesce("root", "fp").alias("root"))
    roots = labelled.groupBy("root").agg(F.min("smallest").alias("component_id"))
    named = labelled.join(roots, "root").select(F.col("fp").alias("__fp"), "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, prints["fp"].eqNullSafe(named["__fp"])).select("doc_id", shown, "component_id")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """Only the row with the smallest id of each component; all columns stay.

    Rows that repeat the smallest id stay together, and so do those of a
    component without any id.
    """
    found = simhash_components(docs, **options)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return keep_ids(docs, first)
