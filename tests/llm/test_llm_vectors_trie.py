"""Vector searches and the conversation trie against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from arborframe.llm import hard_negatives, multi_index, prefix_trie, queries

# ---------------------------------------------------------------- vectors
VECTORS = "vec_id long, embedding array<float>, label int, row long, vector string, codes int, cell int, rank int, score int"


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", 2, 3, 4, 5) for r in rows], VECTORS)


def some_vectors(count, seed=3, width=12):
    """Clustered vectors with ties, copies, repeats and rows that take no part."""
    draw = random.Random(seed)
    centers = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(count):
        center = centers[i % 4]
        rows.append((i, [float(np.float32(x + draw.gauss(0, 0.4))) for x in center], draw.randrange(4)))
    rows += [(1000 + i, rows[5][1], i % 4) for i in range(30)]  # one vector in many rows
    rows += [(40, None, 1), (2000, [1.0] * width, None), (2001, [float("nan")] * width, 1), (2002, [1.0, None], 1), (2003, [float("inf")] + [0.0] * (width - 1), 2)]
    rows += [(None, [1.0] * width, 1), (2004, [0.0] * width, 1), (2005, [0.5, 0.25], 2), (2006, [], 3), (2010, [-1.0] * width, 0), (2100, [1e30] * width, 1)]
    return rows


def mined(rows, every, positives=5, negatives=10):
    """Every pair scored in Python integers."""
    usable = []
    for vec_id, vector, label in rows:
        if vec_id is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        scaled = [math.floor(256 * x) for x in vector]
        if sum(x * x for x in scaled) <= 2**52:
            usable.append((vec_id, label, scaled))
    out = []
    for a, label, v in usable:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), b, other == label) for b, other, w in usable if b != a)
        for score, positive, _ in [s for s in scored if s[2]][:positives]:
            band = [s for s in scored if not s[2] and 30 * -score <= 100 * -s[0] <= 90 * -score]
            out += [(a, positive, rank, b, -score, -s) for rank, (s, b, _) in enumerate(band[:negatives], 1)]
    return sorted(out)


def test_hard_negatives_against_all_pairs(spark, monkeypatch):
    rows = some_vectors(300)
    expected = mined(rows, 10)
    got = hard_negatives.mine(vector_table(spark, rows), anchor_every=10)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == expected and len(expected) > 500
    # the same with many blocks of rows and of anchors, and with a single code
    monkeypatch.setattr(hard_negatives, "block_rows", lambda width: 13)
    got = hard_negatives.mine(vector_table(spark, rows), anchor_every=10, levels=1, planes=3)
    assert sorted(tuple(r) for r in got.collect()) == expected


def test_hard_negatives_of_few_or_no_rows(spark):
    assert hard_negatives.mine(vector_table(spark, []).limit(0)).count() == 0
    lone = [(100, [1.0, 0.0], 1), (101, [1.0, 0.5], 2)]
    assert hard_negatives.mine(vector_table(spark, lone)).count() == 0
    few = [*lone, (102, [1.0, 0.0], 1), (103, [0.5, 0.0], 2), (103, [0.5, 0.0], 2)]
    assert [tuple(r) for r in hard_negatives.mine(vector_table(spark, few)).collect()] == [(100, 102, 1, 103, 65536, 32768), (100, 102, 2, 103, 65536, 32768)]


def by_contract(rows):
    """Every pair of the query's rows scored in Python integers; a score that no long holds is None."""
    usable = []
    for vec_id, vector, label in rows:
        if vector is not None and label is not None and all(x is not None and math.isfinite(x) for x in vector):
            usable.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    out = []
    for a, label, v in usable:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b, other == label) for b, other, w in usable if b != a)
        for score, positive, _ in [s for s in scored if s[2]][:5]:
            band = [s for s in scored if not s[2] and 30 * -score <= 100 * -s[0] <= 90 * -score][:10]
            held = [(p if -(2**63) <= p < 2**63 else None for p in (-score, -s)) for s, _, _ in band]
            out += [(a, positive, rank, b, *pair) for rank, ((_, b, _), pair) in enumerate(zip(band, held, strict=True), 1)]
    return out


@pytest.mark.parametrize("sizes", [(1e5,), (1e6,), (1, 1, 1e5, 1e7), (0, 1, 1e8, 1e30)])
def test_hard_negatives_of_long_vectors(spark, tmp_path, sizes):
    """Vectors whose scores exceed 2**53, and some that exceed a long, take part with exact scores."""
    draw = random.Random(8)
    rows = []
    for i in range(300):
        size = draw.choice(sizes)
        rows.append((i, [float(np.float32(size * draw.gauss(0.3, 0.4))) for _ in range(16)], draw.randrange(4)))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    expected = by_contract(rows)
    got = [tuple(r) for r in queries.op11_hard_negatives(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and len(expected) > 40


def test_order_keys_follow_the_scores():
    numbers = sorted(s * (2**k + d) for k in (62, 63, 64, 71, 72, 200, 2000) for d in (-1, 0, 1) for s in (-1, 1))
    keys = [hard_negatives.order_key(n) for n in numbers]
    assert [k or hard_negatives.FITS for k in keys] == sorted(k or hard_negatives.FITS for k in keys)
    assert all(hard_negatives.from_order_key(k) == n for k, n in zip(keys, numbers, strict=True) if k)
    assert [n for k, n in zip(keys, numbers, strict=True) if k is None] == [n for n in numbers if -(2**63) <= n < 2**63]


def test_intervals_hold_every_product():
    draw = np.random.default_rng(5)
    for width in (1, 3, 64, 100):
        vectors = np.floor(draw.normal(size=(200, width)) * draw.choice([1, 300], (200, 1)))
        vectors[::9] = 0
        turned = hard_negatives.rotate(vectors)
        assert np.allclose(turned @ turned.T, vectors @ vectors.T)
        words, alignments, hull, residual = hard_negatives.one_bit_codes(turned, 2)
        ones = np.bitwise_count(words).sum(axis=2).astype(float)
        for at in range(0, 200, 7):
            _, least, greatest = hard_negatives.Planes(turned[at], 4).intervals(words, ones, alignments, hull, residual)
            exact = vectors @ vectors[at]
            assert (least <= exact).all() and (exact <= greatest).all()


def nearest(rows, every, k=5):
    usable = []
    for vec_id, vector, _ in rows:
        if vec_id is None or vector is None or any(x is None or not math.isfinite(x) for x in vector) or not any(vector):
            continue
        big = max(map(abs, vector))
        scaled = [x / big for x in vector]
        length = math.sqrt(math.fsum(x * x for x in scaled))
        usable.append((vec_id, [x / length for x in scaled]))
    out = {}
    for a, v in usable:
        if a % every == 0:
            scores = sorted(((round(-math.fsum(x * y for x, y in zip(v, w, strict=False)), 12), b) for b, w in usable if b != a))
            out[a] = [(b, -s) for s, b in scores[:k]]
    return out


def test_multi_index_is_exact_where_the_walk_passes_all_rows(spark):
    rows = some_vectors(300)
    got = defaultdict(list)
    for r in sorted(multi_index.search(vector_table(spark, rows), query_every=10).collect()):
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 12)))
    expected = nearest(rows, 10)
    assert got.keys() == expected.keys() and 2100 in got
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in expected.items()}
    assert all(abs(s - t) < 1e-11 for k in got for (_, s), (_, t) in zip(got[k], expected[k], strict=True))


def test_multi_index_of_few_or_no_rows(spark):
    assert multi_index.search(vector_table(spark, []).limit(0)).count() == 0
    assert multi_index.search(vector_table(spark, [(50, [0.0, 0.0], 1), (51, [1.0, 0.0], 1)])).count() == 0
    few = [(50, [1.0, 0.0], 1), (50, [1.0, 0.0], 1), (51, [2.0, 2.0], None), (52, [-1.0, 0.0], 1), (53, [2.0, 2.0], 1)]
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in multi_index.search(vector_table(spark, few)).collect()]
    assert sorted(got) == [(50, 1, 51, 0.707106781), (50, 2, 53, 0.707106781), (50, 3, 52, -1.0)]


def test_walk_takes_cells_by_summed_distance():
    draw = np.random.default_rng(2)
    for lines, columns in ((1, 1), (1, 6), (7, 1), (9, 5)):
        first, second = draw.random(lines), draw.random(columns)
        rows_in = draw.integers(0, 4, lines * columns)
        order = sorted((first[i] + second[j], i * columns + j) for i in range(lines) for j in range(columns) if rows_in[i * columns + j])
        for wanted in (1, 5, 10**6):
            cells, passed = [], 0
            for _, cell in order:
                if passed < wanted:
                    cells.append(cell)
                    passed += rows_in[cell]
            assert multi_index.walk_cells(first, second, rows_in.tolist(), wanted) == cells


def test_multi_index_recall(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "LEAST_ROWS", 0)
    monkeypatch.setattr(multi_index, "block_rows", lambda width: 100)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").limit(2000)
    rows, index = multi_index.build(table)
    assert rows.count() == 2000 and 0 < index.share < 0.9
    got = defaultdict(set)
    for r in multi_index.search(table).collect():
        got[r["query_id"]].add(r["vec_id"])
    exact = nearest([(r["vec_id"], r["embedding"], 0) for r in table.collect()], 50)
    assert sum(len(got[q] & {i for i, _ in near}) for q, near in exact.items()) >= 0.9 * sum(map(len, exact.values()))


def test_groups_split_large_lines():
    start, parts, number = multi_index.groups_of({0: 5, 1: 3, 2: 25, 4: 9, 5: 9}, 6, 10)
    assert parts.tolist() == [1, 1, 3, 1, 1, 1]
    used = Counter(g for s, p in zip(start, parts, strict=True) for g in range(s, s + p))
    assert start[0] == start[1] and used[start[2]] == used[start[2] + 2] == 1 and number == max(used) + 1


# ---------------------------------------------------------------- conversations
TURNS = "conv_id long, turn long, role string, text string, path int, words int, shard int, key string, depth int"


def turn_table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "k", 4) for r in rows], TURNS)


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: (t[:2], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()))
    own = {c: [t[2:] for t in turns] for c, turns in own.items()}
    members = defaultdict(list)
    full = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        full[conv] = tuple(own.get(conv - conv % 20, [])[:h] + turns[h:])
        for depth in range(len(full[conv]) + 1):
            members[full[conv][:depth]].append(conv)
    children, leaves, kept = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for path, convs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for up in range(len(path) + 1):
            kept[path[:up]] += (len(convs) - 1) * words
            leaves[path[:up]] += path not in children
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if full[c] == path))
        parent = min(members[path[:-1]]) if path else None
        out.append((min(convs), len(path), parent, len(convs), children[path], leaves[path], kept[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some_turns(seed):
    draw = random.Random(seed)
    texts = ["", None, "a b", "c", "x  y\tz\n", "é ü", "long " * 200]
    rows = []
    for conv in range(300):
        rows += [(conv, t if draw.random() < 0.9 else None, draw.choice(["user", "assistant", None]), draw.choice(texts)) for t in range(draw.randrange(1, 6))]
    for conv in range(500, 900):  # copies of one conversation
        rows += [(conv, t, "user", f"hello {t}") for t in range(8)]
    rows += [(conv, t, "user", f"{conv} hello {t}") for conv in (1000, 1001) for t in range(300)]
    rows += [(1003, t, "user", f"1001 hello {t}") for t in range(250)]
    rows += [(None, 1, "user", "nobody"), (7, 1, "user", "again"), (7, 1, "user", "again"), (10_000, 0, "user", "one turn"), (10_001, 0, "user", "alone")]
    return rows


def trie_of(table):
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(table).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_plain_python(spark, seed, monkeypatch):
    rows = some_turns(seed)
    assert trie_of(turn_table(spark, rows)) == plain_trie(rows)
    # many small shards, chunks of a few members, and a skeleton that is joined by key
    for name, value in (("SHARD_CONVERSATIONS", 20), ("CHUNK", 3), ("SKELETON_ROWS", 0)):
        monkeypatch.setattr(prefix_trie, name, value)
    assert trie_of(turn_table(spark, rows)) == plain_trie(rows)


def test_trie_of_few_or_no_turns(spark):
    assert trie_of(turn_table(spark, []).limit(0)) == []
    assert trie_of(turn_table(spark, [(None, 0, "user", "x")])) == []
    alone = [(41, 0, "user", "x y")]  # its base is absent
    assert trie_of(turn_table(spark, alone)) == plain_trie(alone)
    copies = [(c, t, "user", "x y") for c in range(0, 4000, 20) for t in range(3)]
    assert trie_of(turn_table(spark, copies)) == plain_trie(copies)


def test_shared_depth():
    a, b, c = b"a" * 16, b"b" * 16, b"c" * 16
    assert [prefix_trie.shared_depth(*x) for x in ((b"", a), (a + b, a), (a + b, a + c), (a + b + c, a + b + c), (b, a))] == [0, 1, 1, 3, 0]
