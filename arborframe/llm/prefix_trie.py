"""The trie of conversation prefixes, from range-partitioned shards and the skeleton between them.

A conversation's path is the row of its turns' 16-byte digests, so that paths
compare as bytes. Range partitioning deals the sorted paths to shards. The
members of a node stand side by side in that order: only a prefix that the last
path of a shard shares with the first path of the next one has members in both.
These prefixes are the skeleton, the trie of the splitters' paths. It is
broadcast to the shards as one pair of depths per shard, since the prefixes
themselves are those of a shard's first and last path. A shard finishes all
other nodes in one walk, and its partial aggregates of skeleton nodes are
combined by key. Each node and each leaf is counted in one shard only, which
makes every aggregate a plain sum.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from arborframe.session import ensure_checkpoint_dir, saved

#: Bytes of a turn in a path.
STEP = 16
#: Conversations and turns of a shard, on average at most.
SHARD_CONVERSATIONS, SHARD_TURNS = 1 << 14, 1 << 17
#: Members of a skeleton node that are sent in one row.
CHUNK = 4096
#: The skeleton is broadcast up to this number of nodes, of about 24 bytes each, and joined by key beyond it.
SKELETON_ROWS = 200_000

WORD = r"[^\x20\x09-\x0D]+"
EMPTY_SHA256 = hashlib.sha256().hexdigest()

WALKED = pa.schema(
    [
        ("kind", pa.string()),
        ("key", pa.binary()),
        ("parent_key", pa.binary()),
        ("conv_id", pa.int64()),
        ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()),
        ("ends", pa.list_(pa.int64())),
    ]
)
WALKED_DDL = (
    "kind string, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, ends array<long>"
)
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversation_paths(turns: DataFrame) -> DataFrame:
    """One row per conversation: its path and the words of each turn, in turn order (null first, ties by digest)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    each = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")).alias("it")
    )
    listed = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("it")).alias("them"))
    return listed.select("conv_id", F.unhex(F.array_join(F.col("them.digest"), "")).alias("path"), F.col("them.words").alias("words"))


def rebuilt(paths: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % every, h = crc32(c) % heads."""
    head = paths.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.substring("path", 1, STEP * (heads - 1)).alias("head"), F.slice("words", 1, heads - 1).alias("head_words")
    )
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    joined = paths.withColumn("h", taken).join(head, F.col("conv_id") - F.col("conv_id") % every == F.col("base"), "left")
    first, first_words = F.coalesce("head", F.lit(b"")), F.coalesce("head_words", F.array().cast("array<int>"))
    return joined.select(
        "conv_id",
        F.concat(F.substring(first, F.lit(1), F.col("h") * STEP), F.substring("path", F.col("h") * STEP + 1, F.length("path"))).alias("path"),
        F.concat(F.slice(first_words, F.lit(1), F.col("h")), F.slice("words", F.col("h") + 1, F.size("words"))).alias("words"),
    )


def shared_depth(one: bytes, other: bytes) -> int:
    """Turns that two paths have in common from the start."""
    end = min(len(one), len(other))
    if one[:end] == other[:end]:
        return end // STEP
    at = 0
    while one[at : at + STEP] == other[at : at + STEP]:
        at += STEP
    return at // STEP


@F.pandas_udf(LongType())
def common(one: pd.Series, other: pd.Series) -> pd.Series:
    return pd.Series([-1 if a is None or b is None else shared_depth(a, b) for a, b in zip(one, other, strict=True)])


class Node:
    __slots__ = ("children", "conv", "depth", "ends", "grown", "key", "leaves", "n", "pending", "saved", "words")

    def __init__(self, depth: int, words: int, key: bytes | None):
        self.depth, self.words, self.key = depth, words, key
        self.conv, self.n, self.children, self.leaves, self.saved, self.grown = None, 0, 0, 0, 0, False
        self.ends, self.pending = array("q"), []


class Shard:
    """One walk over a shard's sorted paths, with a stack of the nodes of the present path."""

    def __init__(self, left: int, right: int):
        self.left, self.right = left, right
        self.stack: list[Node] = []
        self.path: bytes | None = None
        self.out: list[tuple] = []

    def add(self, conv: int, path: bytes, words) -> None:
        first = self.path is None
        same = -1 if first else shared_depth(self.path, path)
        while len(self.stack) > same + 1:
            self.pop(False)
        for depth in range(same + 1, len(path) // STEP + 1):
            begun_before = first and depth <= self.left
            node = Node(depth, words[depth - 1] if depth else 0, self.key_of(path, depth) if begun_before else None)
            if not begun_before:
                node.saved = -node.words
            if self.stack:
                self.stack[-1].grown = True
                self.stack[-1].children += not begun_before
            self.stack.append(node)
        top = self.stack[-1]
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        top.ends.append(conv)
        self.path = path

    @staticmethod
    def key_of(path: bytes, depth: int) -> bytes:
        return hashlib.blake2b(path[: depth * STEP], digest_size=16).digest()

    def pop(self, last: bool) -> None:
        node = self.stack.pop()
        parent = self.stack[-1] if self.stack else None
        goes_on = last and node.depth <= self.right
        node.leaves += not node.grown and not goes_on
        node.saved += node.n * node.words
        if parent:
            parent.n += node.n
            parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)
            parent.leaves += node.leaves
            parent.saved += node.saved
        if goes_on and node.key is None:
            node.key = self.key_of(self.path, node.depth)
        if node.key is None:
            ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if node.ends else EMPTY_SHA256
            row = (node.conv, node.depth, node.n, node.children, node.leaves, node.saved, ends)
            for child in node.pending:
                self.put(child, None, node.conv)
            if parent is None:
                self.put(row, None, None)
            elif parent.key is None:
                parent.pending.append(row)
            else:
                self.put(row, parent.key, None)
            return
        for child in node.pending:
            self.put(child, node.key, None)
        above = self.key_of(self.path, node.depth - 1) if node.depth else None
        self.out.append(("part", node.key, above, node.conv, node.depth, None, node.n, node.children, node.leaves, node.saved, None, None))
        for at in range(0, len(node.ends), CHUNK):
            self.out.append(("ends", node.key, None, node.ends[at], node.depth, None, None, None, None, None, None, node.ends[at : at + CHUNK].tolist()))

    def put(self, row: tuple, parent_key, parent_conv) -> None:
        conv, depth, n, children, leaves, saved_tokens, ends = row
        self.out.append(("node", None, parent_key, conv, depth, parent_conv, n, children, leaves, saved_tokens, ends, None))

    def end(self) -> None:
        while self.stack:
            self.pop(True)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def walk(batches):
    shard = None
    for batch in batches:
        words = batch.column("words")
        for at, (conv, path) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("path").to_pylist(), strict=True)):
            if shard is None:
                shard = Shard(batch.column("left")[at].as_py(), batch.column("right")[at].as_py())
            shard.add(conv, path, words[at].values.to_numpy(zero_copy_only=False).tolist() if path else [])
        if shard and len(shard.out) >= 4096:
            yield as_batch(shard.out, WALKED)
            shard.out = []
    if shard:
        shard.end()
        yield as_batch(shard.out, WALKED)


HASHED = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])


def hash_ends(batches):
    """SHA-256 of each skeleton node's end members from sorted chunks, one running digest at a time."""
    key, running, done = None, None, []
    for batch in batches:
        for now, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            listed = ",".join(map(str, ends)).encode()
            if now != key:
                if running:
                    done.append((key, running.hexdigest()))
                key, running = now, hashlib.sha256(listed)
            else:
                running.update(b"," + listed)
    if running:
        done.append((key, running.hexdigest()))
    yield as_batch(done, HASHED)


def shards(paths: DataFrame, least: int = 16) -> DataFrame:
    """Sorted shards of the paths, each with the depths it shares with the shard before (``left``) and after it (``right``), or -1."""
    spark = paths.sparkSession
    ensure_checkpoint_dir(spark)
    count, turns = paths.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    number = max(1, -(-count // SHARD_CONVERSATIONS), -(-turns // SHARD_TURNS), min(least, count // 64))
    # A checkpoint keeps partitions and their order, and outlives its executors.
    dealt = paths.repartitionByRange(number, "path", "conv_id").sortWithinPartitions("path", "conv_id").checkpoint()
    dealt = dealt.withColumn("shard", F.spark_partition_id())
    ends = dealt.groupBy("shard").agg(F.min(F.struct("path", "conv_id")).alias("first"), F.max(F.struct("path", "conv_id")).alias("last"))
    order = Window.orderBy("shard")  # one row per shard
    near = ends.select("shard", F.lag("last.path").over(order).alias("before"), F.col("first.path").alias("first"), F.col("last.path").alias("last"), F.lead("first.path").over(order).alias("after"))
    depths = near.select("shard", common("before", "first").alias("left"), common("last", "after").alias("right"))
    return dealt.join(F.broadcast(depths), "shard")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row per node of the trie of ``paths`` (conv_id, path, words per turn), the root included.

    A node's conv_id is its smallest member; parent_conv_id is its parent's
    (null for the root). n_leaves and saved_tokens cover the whole subtree.
    Without conversations there is no node.
    """
    spark = paths.sparkSession
    walked = saved(shards(paths).mapInArrow(walk, WALKED_DDL), "walked")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = walked.where("kind = 'part'").groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), *sums)
    ends = walked.where("kind = 'ends'").select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id")
    hashed = ends.select("key", "ends").mapInArrow(hash_ends, "key binary, ends_sha256 string")
    skeleton = saved(parts.join(hashed, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256))), "skeleton")
    parents = skeleton.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    if skeleton.count() <= SKELETON_ROWS:
        parents = F.broadcast(parents)

    def linked(rows: DataFrame) -> DataFrame:
        return rows.drop("parent_conv_id").join(parents, "parent_key", "left").withColumnRenamed("above", "parent_conv_id").select(NODE)

    nodes = walked.where("kind = 'node'")
    inner = nodes.where(F.col("parent_key").isNull()).select(NODE)
    return inner.unionByName(linked(nodes.where(F.col("parent_key").isNotNull()))).unionByName(linked(skeleton))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text; other columns are ignored).

    Null roles and texts count as empty, null turns come first, turns of equal
    number are ordered by their digest. Rows without conv_id belong to no
    conversation. Repeated rows are turns of their own. One conversation's
    digests, 16 bytes a turn, are held in one row.
    """
    return prefix_trie(saved(rebuilt(saved(conversation_paths(turns), "paths")), "rebuilt"))


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce("text", '') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
      list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, t.i AS place, t.role, t.body FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, t.i + c.h, t.role, t.body FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
p AS (
  SELECT c.conv_id, coalesce(string_agg(md5(length(r.role) || ':' || r.role || r.body), '' ORDER BY r.place), '') AS path
  FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
w AS (
  SELECT md5(length(role) || ':' || role || body) AS digest, max(len(regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+'))) AS words FROM t GROUP BY 1),
m AS (SELECT conv_id, path, unnest(range(0, length(path) // 32 + 1)) AS depth FROM p),
n AS (
  SELECT depth, substr(path, 1, 32 * depth) AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length(path) = 32 * depth), '') AS ends
  FROM m GROUP BY ALL),
k AS (SELECT substr(prefix, 1, 32 * (depth - 1)) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
o AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n.n_convs - 1) * coalesce(w.words, 0) AS own
  FROM n LEFT JOIN k USING (prefix) LEFT JOIN w ON w.digest = right(n.prefix, 32)),
u AS (SELECT substr(prefix, 1, 32 * up) AS prefix, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT prefix, own, n_children, unnest(range(0, depth + 1)) AS up FROM o) GROUP BY 1)
SELECT o.conv_id, o.depth, a.conv_id AS parent_conv_id, o.n_convs, o.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(o.ends) AS ends_sha256
FROM o JOIN u USING (prefix) LEFT JOIN n a ON o.depth > 0 AND a.prefix = substr(o.prefix, 1, 32 * (o.depth - 1))
"""
