"""Every operator on small awkward tables, against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arborframe.llm import covering, decontamination, katz, language_id, license_scan, mixing, multiset_hash, piece_counts, queries, token_files, warc
from arborframe.llm.components import components
from arborframe.session import ensure_checkpoint_dir

EN = "The quick brown fox jumps over the lazy dog. It was a bright cold day in April, and the clocks were striking thirteen."
DE = "Der schnelle braune Fuchs springt über den faulen Hund. Es war ein heller, kalter Tag im April, und die Uhren schlugen dreizehn."
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
TEXTS = [None, "", "   \n ", EN, DE, EN, EN + "\n" + DE, LONG, "12 34 !!", "x" * 5000, "Released under the MIT License.", "a  b   c \n d", "é ü 日本語 🙂 ok", "<|endoftext|> mid <|endoftext|>"]

# columns that clash with names that operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, chunk int, fp long, n long, at int, __kept_id long, bucket int, words string, pos int"


def build(spark, texts, langs=None, ids=None):
    rows = []
    for i, text in enumerate(texts):
        lang = (langs[i] if langs else ("de" if text == DE else "en")) if text else None
        rows.append((ids[i] if ids else i, text, lang, f"src{i % 5}" if i % 7 else None, len(text or ""), 1, 2, 3, 4, 5, 6, 7, "w", 8))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return build(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_names():
    assert [n.partition("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


# ---------------------------------------------------------------- 1
def page_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, id string, chunk_no int")


def test_warc_records(spark):
    big = "ä" * 1_500_000
    rows = [(1, "http://a", None), (2, None, ""), (3, "http://a b\r\nc", "x" * 1000), (4, "u", "x" * 1000), (9, "u", "x" * 1000), (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", big), (8, "u", "WARC/1.1\r\n\r\nHTTP"), (9, "u", "x" * 1000)]
    found = sorted(tuple(r) for r in warc.page_records(page_table(spark, rows)).collect())
    expected = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = max(p for p, _, h in rows if (h or "").encode() == data)
        visit = len(data) >= 1000 and page != same
        expected.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if visit else "response", same if visit else None, 1 if visit else max(1, math.ceil(len(data) / warc.CHUNK_BYTES))))
    assert found == sorted(expected)
    assert warc.page_records(page_table(spark, [])).count() == 0


def test_warc_chunks_carry_running_digests(spark, tmp_path):
    text = "".join(random.Random(1).choices("abcdef\r\n", k=10_000))
    records = warc.record_table(page_table(spark, [(1, "u", text), (None, "u", "tail")]))
    segments = warc.write_archives(records, f"file:{tmp_path}/w", segment_bytes=1)
    rows = warc.read_chunks(segments, f"file:{tmp_path}/w", chunk_bytes=1000).where("id = 1").orderBy("chunk_no").collect()
    assert b"".join(bytes(r["data"]) for r in rows) == text.encode()
    assert [r["bytes_so_far"] for r in rows] == list(range(1000, 10_001, 1000))
    assert [r["digest_so_far"] for r in rows] == [hashlib.sha1(text.encode()[: r["bytes_so_far"]]).hexdigest() for r in rows]
    assert [r["last"] for r in rows] == [False] * 9 + [True]


def test_warc_segments_are_read_by_many_tasks(spark, tmp_path):
    """500 segments with adaptive execution on."""
    pages = page_table(spark, [(i, "http://x.org/", f"page {i} " + "z" * (i % 7) * 300) for i in range(500)])
    segments = warc.write_archives(warc.record_table(pages), f"file:{tmp_path}/w", segment_bytes=1)
    assert segments.count() == 500 and spark.conf.get("spark.sql.adaptive.enabled") == "true"
    chunks = warc.read_chunks(segments, f"file:{tmp_path}/w", task_bytes=1)
    readers = chunks.select(F.spark_partition_id().alias("task"), "id").distinct().collect()
    assert len({r["task"] for r in readers}) > 100 and {r["id"] for r in readers} == set(range(500))
    few = warc.read_chunks(segments, f"file:{tmp_path}/w").select(F.spark_partition_id().alias("task")).distinct().count()
    assert few >= min(4, spark.sparkContext.defaultParallelism)


# ---------------------------------------------------------------- 2
def test_language_id(spark, empty):
    rng = random.Random(3)
    words = {"en": "the and of with that this from have which their".split(), "de": "der die und nicht eine mit auf werden sich über".split(), "fr": "les des une dans pour que avec être plus été".split()}
    texts, langs = [], []
    for lang, own in words.items():
        for _ in range(80):
            texts.append(" ".join(rng.choices(own, k=25)))
            langs.append(lang)
    texts += [None, "", "123 456", LONG]
    langs += [None, None, None, None]
    table = build(spark, texts, langs)
    rows = by_id(language_id.identify(table))
    for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        assert rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= rows[i]["score"] <= 1
        if lang:
            assert rows[i]["lang_pred"] == lang
        elif text != LONG:
            assert (rows[i]["lang_pred"], rows[i]["score"]) == ("und", 0.0)
    kept = language_id.keep_identified(table)
    assert kept.columns == table.columns
    assert set(range(240)) <= {r["doc_id"] for r in kept.collect()}
    assert language_id.identify(empty).count() == 0
    unlabelled = language_id.identify(build(spark, [EN, None], [None, None]))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_ftrl_is_sparse_and_shards_average():
    rng = np.random.default_rng(0)
    s = language_id.Settings()
    rows = [(np.array([label, 10 + int(rng.integers(500))]), np.array([0.9, 0.1]), label) for label in rng.integers(0, 2, 400)]
    state = (np.zeros((1 << language_id.BUCKET_BITS, 2)), np.zeros((1 << language_id.BUCKET_BITS, 2)), np.zeros(2), np.zeros(2))
    z, n, zb, nb = language_id.train_shard(rows, state, s)
    w = language_id._weights(z, n, s)
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0]
    assert (w[10:] == 0).mean() > 0.99
    moved = np.flatnonzero(n.any(axis=1))
    again = language_id._unpack(language_id._pack(moved, (z, n, zb, nb), 400))
    assert again[2] == 400 and np.array_equal(again[1][0], z[moved])
    assert np.allclose(language_id._average(state, [again, again])[0], z)


# ---------------------------------------------------------------- 3
def water(given, children):
    """Exact share by repeated filling: {name: (supply, weight)} to real amounts."""
    from fractions import Fraction

    amount, live, left = dict.fromkeys(children, Fraction(0)), set(children), Fraction(given)
    while live:
        weight = sum(children[c][1] for c in live)
        full = {c for c in live if children[c][0] * weight <= left * children[c][1]}
        if not full:
            for c in live:
                amount[c] = left * children[c][1] / weight
            break
        for c in full:
            amount[c] = Fraction(children[c][0])
        left -= sum(children[c][0] for c in full)
        live -= full
    return amount


def test_fill_matches_repeated_filling(spark):
    rng = random.Random(5)
    cases = {p: (rng.randint(0, 3000), {f"c{i}": (rng.randint(1, 600), rng.randint(1, 9)) for i in range(rng.randint(1, 8))}) for p in range(30)}
    rows = [(p, min(given, sum(s for s, _ in cs.values())), c, s, w) for p, (given, cs) in cases.items() for c, (s, w) in cs.items()]
    frame = spark.createDataFrame(rows, "p int, given long, c string, supply long, weight int").withColumn("weight", F.col("weight").cast("decimal(19,0)"))
    found = mixing.fill(frame, ["p"], "c").collect()
    for p, (given, children) in cases.items():
        given = min(given, sum(s for s, _ in children.values()))
        mine = {r["c"]: r["budget"] for r in found if r["p"] == p}
        assert sum(mine.values()) == given
        for c, exact in water(given, children).items():
            assert abs(mine[c] - exact) < 1 and mine[c] <= children[c][0]


@pytest.mark.parametrize("permille,epochs", [(300, 1), (700, 2), (1000, 1), (3000, 2)])
def test_mixing_takes_prefixes_of_seeded_epochs(spark, docs, permille, epochs):
    plan = mixing.Plan(budget_permille=permille, max_epochs=epochs)
    rows = [r.asDict() for r in mixing.leaf_rows(docs).collect()]
    total = sum(r["n_tokens"] for r in rows)
    taken = [r.asDict() for r in mixing.select_tokens(docs, plan).collect()]
    assert sum(r["taken"] for r in taken) == min(total * permille // 1000, total * epochs)
    budgets = {(r["domain"], r["language"], r["source"]): r for r in mixing.budgets(mixing.leaf_rows(docs), plan).collect()}
    for leaf, goal in budgets.items():
        mine = [r for r in rows if (r["domain"], r["language"], r["source"]) == leaf and r["n_tokens"]]
        left, expected = goal["budget"], []
        for epoch in range(epochs + 1):
            for r in sorted(mine, key=lambda r: (hashlib.md5(f"{plan.seed}:{epoch}:{r['doc_id']}".encode()).hexdigest()[: mixing.HASH_DIGITS], r["doc_id"])):
                if left > 0:
                    expected.append((epoch, r["doc_id"], min(left, r["n_tokens"])))
                    left -= r["n_tokens"]
        assert sorted(expected) == sorted((r["epoch"], r["doc_id"], r["taken"]) for r in taken if (r["domain"], r["language"], r["source"]) == leaf)


def test_mixing_empty_and_repeated(spark, empty):
    assert mixing.select_tokens(empty).count() == 0
    same = build(spark, ["a b c d"] * 10, ids=[4] * 10)
    assert sum(r["taken"] for r in mixing.select_tokens(same, mixing.Plan(budget_permille=550, max_epochs=1)).collect()) == 22
    kept = mixing.keep_selected(same)
    assert kept.columns == same.columns and kept.count() == 10


# ---------------------------------------------------------------- 4
ITEMS = [
    (0, "A train travels 120 km in 2 hours and then Alice walks 3 miles to school before Bob meets Alice at noon"),
    (1, "What is the capital city of the largest country in the southern half of the continent"),
    (2, "short item here"),
    (3, None),
    (4, ""),
]


def test_decontamination(spark, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    pad = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor "
    texts = {
        0: pad + ITEMS[0][1] + " " + pad,
        1: pad + "A train travels 75 km in 4 hours and then Carol walks 9 miles to school before Dave meets Carol at noon " + pad,
        2: pad + "A train travels 75 km in 4 hours and then Carol walks 9 miles to school before Dave meets Erin at noon",
        3: pad + ITEMS[1][1].upper() + ", " + pad,
        4: pad * 3,
        5: None,
        6: "",
        7: "the capital city of the " + pad,
        8: "Short  item,\nhere!",
        9: pad * 400 + ITEMS[1][1] + pad * 400,
        10: ITEMS[1][1].replace(" ", "\n") + " " + ITEMS[0][1],
    }
    table = build(spark, list(texts.values()) + [texts[0]], ids=[*texts, 0])
    found = decontamination.contaminated(table, bench).collect()
    pairs = sorted((r["doc_id"], r["item_id"]) for r in found)
    assert pairs == [(0, 0), (1, 0), (2, 0), (3, 1), (8, 2), (9, 1), (10, 0), (10, 1)]
    changed = {(r["doc_id"], r["item_id"]): r["slots_changed"] for r in found}
    assert changed[1, 0] and not changed[0, 0]
    # an inconsistent slot takes its windows away: Carol cannot be both Alice and someone else
    covered = {(r["doc_id"], r["item_id"]): r["covered"] for r in found}
    assert covered[0, 0] == covered[1, 0]
    kept = decontamination.drop_contaminated(table, bench)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 7]
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(table, bench.limit(0)).count() == 0


def test_decontamination_keeps_rows_of_one_id_apart(spark):
    """Halves of an item in different rows of one id, or of none, are no whole; only the row with the item goes."""
    words = "seven wise old owls count every bright silver coin that rolls slowly down the narrow wooden stairs at dawn".split()
    item = " ".join(words)
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    halves = [" ".join(words[:9]), " ".join(words[9:])]
    for ids in ([5, 5], [None, None], [5, 6]):
        assert decontamination.contaminated(build(spark, halves, ids=ids), bench, run=99).count() == 0
    table = build(spark, [item, "clean and short", item, "another clean text"], ids=[None, None, 3, 3])
    assert sorted(r["text"] for r in decontamination.drop_contaminated(table, bench).collect()) == ["another clean text", "clean and short"]
    split = spark.createDataFrame([(None, halves[0] + " and more words follow here now"), (None, halves[1] + " and other words end it all then")], "item_id long, text string")
    assert decontamination.contaminated(build(spark, [halves[0] + " then " + halves[1]]), split, coverage=0.7, run=99).count() == 0


def test_inconsistent_numbers_are_no_match(spark):
    bench = spark.createDataFrame([(0, "take 5 red apples then add 5 green apples and again 5 blue apples")], "item_id long, text string")
    texts = ["take 7 red apples then add 7 green apples and again 7 blue apples", "take 7 red apples then add 8 green apples and again 9 blue apples"]
    assert [r["doc_id"] for r in decontamination.contaminated(build(spark, texts), bench).collect()] == [0]


def test_only_windows_with_a_clashing_slot_are_left_out(spark):
    tail = " and then the children carry all of them slowly over the old wooden bridge before supper"
    bench = spark.createDataFrame([(0, "take 5 red apples then add 5 green pears" + tail), (1, "with 3 small carts and 5 large ones the farmer drove" + tail[9:])], "item_id long, text string")
    texts = [
        "take 5 red apples then add 6 green pears" + tail,  # one of two equal numbers was edited
        "with 4 small carts and 4 large ones the farmer drove" + tail[9:],  # new values coincide
        "take 7 red apples then add 8 green pears" + tail,  # one value in two slots
    ]
    found = decontamination.contaminated(build(spark, texts), bench, coverage=0.7).collect()
    assert {(0, 0), (1, 1), (2, 0)} <= {(r["doc_id"], r["item_id"]) for r in found}
    assert decontamination.consistent([(0, 2, ["5"], ["6"], [1]), (2, 2, ["5"], ["7"], [0]), (4, 2, ["5"], ["5"], [0]), (6, 2, [], [], [])]) == ([0, 1, 4, 5, 6, 7], True)


def test_number_heavy_short_and_partly_copied_items(spark):
    long = " ".join(f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "po", "ra") for b in ("den", "fos", "gim", "hul", "jar", "kep", "lon", "mis"))
    bench = spark.createDataFrame([(0, "What is 12 + 5 - 3 * 7?"), (1, "name seven seas"), (2, long), (3, "is 4 a prime")], "item_id long, text string")
    pad = "lorem ipsum dolor sit amet consectetur adipiscing elit "
    texts = [
        pad + "what is 12 + 5 - 3 * 7? " + pad,
        pad + "what is 13 + 6 - 4 * 8? " + pad,
        pad + "Name seven seas, please " + pad,
        pad + " ".join(long.split()[10:35]) + " " + pad,
        pad + " ".join(long.split()[10:20]) + " " + pad,
        pad + "tell me: is 4 a prime " + pad,
        pad + "a list of words, and m or s " + pad,
    ]
    found = decontamination.contaminated(build(spark, texts), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(0, 0), (2, 1), (3, 2), (5, 3)]


def test_filter_has_no_misses():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    table = np.zeros(1 << 12, dtype=np.uint64)
    for bit in decontamination._places(hashes, len(table)):
        np.bitwise_or.at(table, bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
    assert decontamination.in_filter(hashes, table).all()
    assert decontamination.in_filter(rng.integers(0, 1 << 63, 5000, dtype=np.uint64), table).mean() < 0.1


# ---------------------------------------------------------------- 5
def greedy(word, pieces, longest):
    n, i = 0, 0
    while i < len(word):
        j = next((j for j in range(min(len(word), i + longest), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


def test_automaton_counts_greedy_pieces():
    rng = random.Random(7)
    for _ in range(20):
        pieces = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(12)}
        machine = piece_counts.Automaton(pieces)
        words = [bytes(rng.choices(b"abcd", k=rng.randint(1, 14))) for _ in range(300)]
        ends = np.cumsum([len(w) for w in words])
        counted = machine.count_all(np.frombuffer(b"".join(words), np.uint8), np.r_[0, ends[:-1]], ends)
        assert counted.tolist() == [greedy(w, pieces, 5) for w in words] == [machine.count(w) for w in words]


def test_piece_counts(spark, docs, empty):
    path = token_files.tokenizer_file()
    pieces = set(piece_counts.byte_pieces(path))
    longest = max(map(len, pieces))
    rows = by_id(piece_counts.piece_counts(docs, path))
    for i, text in enumerate(TEXTS):
        words = (text or "").encode().split()
        assert (rows[i]["n_words"], rows[i]["n_pieces"]) == (len(words), sum(greedy(b" " + w, pieces, longest) for w in words))
    assert piece_counts.piece_counts(empty, path).count() == 0


# ---------------------------------------------------------------- 6
def test_set_join_finds_what_all_pairs_find():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(14)]
    for threshold in (0.5, 0.7, 0.9, 1.0):
        templates = {f"t{i}": " ".join(rng.choices(vocabulary, k=rng.randint(1, 9))) for i in range(6)} | {"none": ""}
        index = license_scan.build_index(templates, {w.encode(): rng.randint(0, 5) for w in vocabulary}, threshold)
        for _ in range(200):
            block = {w.encode() for w in rng.choices(vocabulary + ["other"], k=rng.randint(0, 12))}
            expected = {}
            for label, text in templates.items():
                words = {w.encode() for w in text.split()}
                if words and len(words & block) >= threshold * len(words) - 1e-9:
                    expected[label] = len(words & block) / len(words)
            assert license_scan.matches(block, index) == expected


def test_license_scan(spark, empty):
    texts = {
        0: "The MIT  License, the mit-license\nand the Apache License; GNU General Public License",
        1: license_scan.TEMPLATES["mit-notice"] + "\n" + LONG,
        2: "permit license",
        3: None,
        4: "",
        5: "Ünder the ÄMIT License mit license mit license",
        6: "Released under the MIT License.",
        7: "Released under the BSD License.",
    }
    rows = by_id(license_scan.scan(build(spark, list(texts.values()))))
    assert (rows[0]["n_base"], rows[0]["first_word"], rows[0]["last_word"], rows[0]["base_labels"]) == (4, 1, 11, "apache,gpl,mit")
    assert rows[1]["labels"] == "mit-notice" and rows[1]["score"] == 1.0 and rows[1]["base_labels"] == ""
    assert [rows[i]["n_base"] for i in (2, 3, 4, 5)] == [0, 0, 0, 2]
    assert rows[2]["first_word"] is None and rows[3]["n_words"] == 0
    assert rows[6]["labels"] == "mit,mit-release" and rows[7]["labels"] == ""
    assert license_scan.scan(empty).count() == 0


def test_license_scan_of_wrapped_and_scattered_words(spark):
    wrapped = {label: "\n".join(f" * {' '.join(w)}" for w in (text.split()[i : i + 5] for i in range(0, len(text.split()), 5))) for label, text in license_scan.TEMPLATES.items()}
    texts = [f"{EN}\n{text}\n{DE}" for text in wrapped.values()]
    scattered = " ".join(w + " lorem ipsum dolor" for w in license_scan.TEMPLATES["mit-notice"].split())
    rows = by_id(license_scan.scan(build(spark, [*texts, scattered])))
    for i, label in enumerate(wrapped):
        assert label in rows[i]["labels"].split(",") and rows[i]["score"] == 1.0
    assert (rows[len(texts)]["labels"], rows[len(texts)]["score"]) == ("", 0.0)


def test_windows_find_what_all_windows_find():
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(12)]
    for threshold in (0.5, 0.7, 1.0):
        templates = {f"t{i}": " ".join(rng.choices(vocabulary, k=rng.randint(1, 8))) for i in range(6)}
        index = license_scan.build_index(templates, {w.encode(): rng.randint(0, 5) for w in vocabulary}, threshold)
        for _ in range(100):
            words = [w.encode() for w in rng.choices(vocabulary + ["other"] * 12, k=rng.randint(0, 60))]
            expected = {}
            for label, text in templates.items():
                mine, span = {w.encode() for w in text.split()}, math.ceil(license_scan.SPREAD * len(text.split()))
                best = max(len(mine & set(words[max(0, i - span) : i])) for i in range(len(words) + 1))
                if best >= threshold * len(mine) - 1e-9:
                    expected[label] = best / len(mine)
            assert license_scan.window_matches(words, index) == expected


# ---------------------------------------------------------------- 7
def katz_by_hand(texts, held, size):
    """Scores by the same definition, one token at a time."""
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    train = [t for t, h in zip(tokens, held, strict=True) if not h]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    top = sorted((w for w in c if w is not None), key=lambda w: (-c[w], w))[:size]
    event = {w: w for w in top} | {None: None}
    of = lambda w: event.get(w, "rare")
    rare_n = n - sum(c[w] for w in event)
    rare_v = max(0, v - len(event))
    uni = {w: (c[w] + 1) / (n + v + 1) for w in event} | {"rare": (rare_n + rare_v + 1) / (n + v + 1)}
    pairs = Counter((a, b) for t in train for a, b in zip(["begin", *map(of, t[:-1])], map(of, t), strict=True) if a != "rare")
    d = katz.discounts(Counter(pairs.values()))
    stats = {}
    for (a, b), k in pairs.items():
        s = stats.setdefault(a, [0, 0.0, 0.0, 0])
        s[0] += k
        s[1] += k * d[min(k, katz.DISCOUNTED + 1)]
        s[2] += uni[b]
        s[3] += 1
    parts = {a: katz.backoff(*s, len(uni)) for a, s in stats.items()}

    def p(a, b):
        if a == "rare" or a not in parts:
            return uni[b]
        den, alpha = parts[a]
        k = pairs.get((a, b), 0)
        return k * d[min(k, katz.DISCOUNTED + 1)] / den if k else alpha * uni[b]

    if n:
        for a in parts:
            assert math.isclose(sum(p(a, b) for b in uni), 1.0, rel_tol=1e-9)
    result = []
    for t in tokens:
        score = base = 0.0
        for a, b in zip(["begin", *map(of, t[:-1])], t, strict=True):
            base += math.log10((c[b] + 1) / (n + v + 1))
            if n:
                score += math.log10(p(a, of(b)))
                if of(b) == "rare":
                    score += math.log10((c[b] + 1) / (rare_n + rare_v + 1))
        result.append((len(t), sum(c[w] > 0 for w in t), n, base, score))
    return result


@pytest.mark.parametrize("size", [3, 40, 100_000])
def test_katz_scores(spark, docs, size):
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choices("the a cat dog sat on mat and ran THE far".split(), k=rng.randint(1, 30))) for _ in range(60)]
    table = build(spark, texts)
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    rows = by_id(katz.score_documents(table, vocabulary_size=size))
    for i, expected in enumerate(katz_by_hand(texts, held, size)):
        r = rows[i]
        assert r["held_out"] == held[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == expected[:3]
        assert math.isclose(r["base_score"], expected[3], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r["score"], expected[4], rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("numbered", [3, 40, 100_000])
def test_katz_keeps_every_history_and_event(spark, numbered, monkeypatch):
    """However few words the tasks know by number, the default is the model of all words."""
    monkeypatch.setattr(katz, "NUMBERED", numbered)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 7_000)
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choices([f"w{int(x)}" for x in (1.03 ** i for i in range(200))], k=rng.randint(1, 60))) for _ in range(60)]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    rows = by_id(katz.score_documents(build(spark, texts)))
    for i, expected in enumerate(katz_by_hand(texts, held, 100_000)):
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == expected[:3]
        assert math.isclose(r["base_score"], expected[3], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r["score"], expected[4], rel_tol=1e-9, abs_tol=1e-9)


def test_katz_stores_counts_once(spark, monkeypatch):
    """The tables are the words, the bigrams, and per bucket its rare words with those that follow them: no copies of bigrams."""
    monkeypatch.setattr(katz, "NUMBERED", 3)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 500)
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["the", "of", "and", *(f"w{i}" for i in range(300))], weights=[200, 150, 100] + [1] * 300, k=40)) for _ in range(50)]
    katz.fit(build(spark, texts))
    rows = {p.name.rpartition("-")[0]: spark.read.parquet(str(p)).count() for p in set(folder.iterdir()) - before}
    words = {w for t in texts for w in t.split()}
    pairs = {p for t in texts for p in itertools.pairwise([None, *t.split(), ""])}
    both = [p for p in pairs if all(p) and not {"the", "of", "and"} & set(p)]
    assert rows.pop("katz-words") == len(words) + 1
    assert rows.pop("katz-bigrams") == len(pairs)
    assert 0 <= rows.pop("katz-rare-words") - (len(words) - 3) <= len(both)
    assert not rows


@pytest.mark.parametrize("bits", [3, 17, 62])
def test_pairs_round_trip(bits):
    rng = np.random.default_rng(bits)
    pairs, n = katz._counted(rng.integers(-(1 << bits), 1 << bits, (400, 2)))
    found = katz._unpack_pairs(katz._pack_pairs(pairs, n))
    assert np.array_equal(found[:2].T, pairs) and np.array_equal(found[2], n)


def test_katz_without_training_text_and_repeats(spark, empty):
    assert katz.score_documents(empty).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = katz.score_documents(build(spark, [EN, EN], ids=[only, only])).collect()
    assert [(r["base_score"], r["score"], r["train_tokens"], r["n_known"]) for r in rows] == [(0.0, 0.0, 0, 0)] * 2


def test_block_round_trip():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 1 << 64, 500, dtype=np.uint64)).repeat(rng.integers(1, 4, 500)).view(np.int64)
    docs, times = rng.integers(0, 99, len(keys)), rng.integers(1, 9, len(keys))
    k, runs, d, t = katz._unpack(katz._pack(keys, docs, times))
    assert np.array_equal(np.repeat(k, runs), keys) and np.array_equal(d, docs) and np.array_equal(t, times)


def test_blocks_are_ordered_by_bucket_key_and_document():
    rng = np.random.default_rng(4)
    for buckets in (1, 14, 70_000):
        keys, docs = rng.integers(-(1 << 63), 1 << 63, 3000).repeat(2), np.sort(rng.integers(0, 50, 6000))
        part = keys % buckets
        assert np.array_equal(katz._in_order(keys, part), np.lexsort((docs, keys.view(np.uint64), part)))
    assert all(katz._expand(katz._squeeze(data)) == data for data in (b"", b"ab" * 9999))


# ---------------------------------------------------------------- 8
def test_token_files_round_trip(spark, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.tokenizer_file())
    texts = [*TEXTS, "tabs\t\there", " lead", "trail  ", "a\x1cb \x1f c", "line\r\n next", "don't  we'll", "² ½ ١٢", "  x"]
    ids = [*range(len(texts) - 2), None, 3]
    found = token_files.encode_and_index(spark, build(spark, texts, ids=ids)).collect()
    start = 0
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or ""))
    for r, i in zip(sorted(found, key=lambda r: r["start"]), order, strict=True):
        expected = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, token_files.END_ID]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (ids[i], start, len(expected))
        assert r["ids_crc32"] == zlib.crc32(np.array(expected, dtype="<u4").tobytes())
        start += len(expected)
    assert token_files.encode_and_index(spark, empty).count() == 0


def test_texts_are_cut_at_blanks_and_lone_line_breaks():
    """Cut texts give the tokenizer's ids, and a line break between words makes no new word."""
    from tokenizers import Tokenizer

    path = token_files.tokenizer_file()
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(7)
    parts = ["a", "B", "é", "1", "²", "'", "'s", "'ll", " ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\x01", ".", "_", "$$", "<|", "Ġ", "字", " \n", "\n\n", "Word,", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(6000)]
    for size in (1, 7, len(texts)):
        for at in range(0, len(texts) if size > 1 else 500, size):
            some = texts[at : at + size]
            expected = [[*ids.ids, 2] for ids in tokenizer.encode_batch(some, add_special_tokens=False)]
            assert [ids.tolist() for ids in token_files.encode_texts(path, some, 2)] == expected
    token_files._load.cache_clear()
    token_files.encode_texts(path, ["one two.\nThree four%%%\nFive", "two two.\nFive four"], None)
    _, _, first, later, lines = token_files._load(path)
    assert (set(first.young), set(later.young) - {""}, set(lines.young)) == ({"one", "two"}, {"one", "two", "four"}, {"Three", "Five"})


def test_token_files_prune(spark, docs, tmp_path):
    path = f"{tmp_path}/tokens"
    token_files.write_token_files(docs, path, token_files.tokenizer_file())
    one = token_files.read_token_files(spark, path).where("doc_id = 3")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in one._jdf.queryExecution().toString()
    assert one.count() == 1


# ---------------------------------------------------------------- 9
def plain_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, docs, empty):
    rows = by_id(covering.simhash_components(docs))
    prints = [plain_simhash(t) for t in TEXTS]
    for i, fp in enumerate(prints):
        assert rows[i]["fingerprint"] == format(fp, "016x")
    assert rows[0]["component_id"] == rows[1]["component_id"] == rows[2]["component_id"] == 0
    assert rows[5]["component_id"] == rows[3]["component_id"] == 3
    assert covering.simhash_components(empty).count() == 0
    kept = covering.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert {0, 3} <= ids and not ids & {1, 2, 5}
    twice = build(spark, [EN, EN, DE], ids=[None, 7, 7])
    assert sorted(r["component_id"] for r in covering.simhash_components(twice).collect()) == [7, 7, 7]


def test_masks_cover_every_pair():
    rng = np.random.default_rng(4)
    for radius in (1, 2, 4):
        masks = covering.covering_masks(radius, 9)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            bits = rng.choice(64, radius, replace=False)
            difference = np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))
            assert (masks & difference == 0).any()


@pytest.mark.parametrize("limit", [3, 10_000])
def test_links_connect_like_all_pairs(spark, limit):
    rng = random.Random(6)
    values = {rng.getrandbits(64) for _ in range(150)}
    for seed in list(values)[:25]:
        for _ in range(12):
            seed ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
            values.add(seed)
    values = np.array(sorted(values), dtype=np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = covering.links(frame, limit=limit)
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= covering.RADIUS):
            a, b = group[i], group[j]
            if a != b:
                group = [min(a, b) if g in (a, b) else g for g in group]
    signed = values.view(np.int64)
    mine = [found.get(int(v), int(v)) for v in signed]
    assert len(set(zip(group, mine, strict=True))) == len(set(group)) == len(set(mine))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (101, 100)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges).collect()}
    assert found == {i: 0 for i in range(1, 51)} | {101: 100}


# ---------------------------------------------------------------- 10
def test_multiset_hash_query(spark, empty):
    ids = [5 * i - 20 for i in range(len(TEXTS))]
    rows = by_id(multiset_hash.edited_table(build(spark, TEXTS, ids=ids)))
    for i, text in enumerate(TEXTS):
        text, following = text or "", TEXTS[(i + 1) % len(TEXTS)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = rows[ids[i]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) >= (text == edited)
    assert rows[ids[0]]["near_next"] == 1.0 and rows[ids[3]]["near_next"] == 0.0
    assert rows[ids[3]]["fingerprint"] == rows[ids[5]]["fingerprint"]
    assert multiset_hash.edited_table(empty).count() == 0


@pytest.mark.parametrize("ids", [[1, 2, 3], [None, 2, 9], [4, 4, 9], [7], [None]])
def test_next_document_in_small_tables(spark, ids, monkeypatch):
    monkeypatch.setattr(multiset_hash, "CHUNK_ROWS", 1)
    texts = ["aaaa", "bbbb", "cccc"][: len(ids)]
    found = multiset_hash.edited_table(build(spark, texts, ids=ids)).collect()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    expected = sorted(hashlib.sha256((texts[i][:2] + texts[order[(k + 1) % len(order)]][:2]).encode()).hexdigest() for k, i in enumerate(order))
    assert sorted(r["edited_sha256"] for r in found) == expected


def test_states_add_and_remove(spark):
    rng = random.Random(8)
    parts = [f"line {rng.randint(0, 40)}." for _ in range(400)]
    a, b = parts[:250], parts[250:]
    texts = ["\n".join(x) for x in (a, b, rng.sample(parts, len(parts)))]
    frame = spark.createDataFrame([(*texts,)], "a string, b string, both string")
    for column in ("a", "b", "both"):
        frame = multiset_hash.with_state(frame, column, f"s_{column}")
    r = frame.select("s_a", "s_both", multiset_hash.add(F.col("s_a"), F.col("s_b")).alias("sum"), multiset_hash.remove(F.col("s_both"), F.col("s_b")).alias("rest")).first()
    assert r["sum"] == r["s_both"] and r["rest"] == r["s_a"]


@pytest.mark.parametrize("n", [20, 2_000, 6_000, 20_000])
def test_likeness_of_long_texts(spark, n):
    a, b = ([f"{name} paragraph {i}" for i in range(n)] for name in "ab")
    half = a[: n // 2] + b[: n // 2]
    frame = spark.createDataFrame([tuple("\n".join(x) for x in (a, b, half))], "a string, b string, half string")
    for column in ("a", "b", "half"):
        frame = multiset_hash.with_state(frame, column, f"s_{column}")
    r = frame.select(*[multiset_hash.likeness(F.col("s_a"), F.col(f"s_{c}")).alias(c) for c in ("a", "b", "half")]).first()
    exact = len({*a} & {*half}) / len({*a} | {*half})
    assert r["a"] == 1.0 and r["b"] < 0.15 and abs(r["half"] - exact) < 0.15


def test_encoding_by_words_equals_the_tokenizer(monkeypatch):
    """Random texts of letters, digits, marks, white space and added tokens, with a cache that turns over all the time."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "CACHE_WORDS", 400)
    monkeypatch.setattr(token_files, "BATCH_CHARS", 3000)
    path = token_files.tokenizer_file()
    tokenizer, draw = Tokenizer.from_file(path), random.Random(4)
    pieces = ["a", "the", "don't", "I'll", "x1", "12", "²", "é", "é", "日本", "🙂", ".", ",", "!?", "...", ";:", "\"", "(", ").", "-", "'s", " ", " ", " ", " ", "\n", "\t", " ", "\x1d", "  ", "<|endoftext|>", "Ġ"]
    weights = [6] * 11 + [2] * 10 + [9] * 4 + [3, 1, 1, 0.1, 1, 0.1, 1]
    texts = ["".join(draw.choices(pieces, weights, k=draw.randrange(60))) for _ in range(1500)]
    got = [row for part in token_files._portions(texts) for row in token_files.encode_texts(path, part, 2)]
    assert [g.tolist() for g in got] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert token_files.encode_texts(path, [], 2) == []
