"""Operator 5: numbers of greedy longest-match word pieces from an automaton.

The vocabulary's byte strings form a trie.  A node that is a piece fails to the
root and pops one piece.  Any other node fails to where its string leads once
the longest pieces at its start are taken off, and pops as many; both follow
from its parent's, so the whole automaton is built in one pass by length.
Reading a word byte by byte, the current node either has a child for the
byte or fails, adding its popped count; the end of the word fails until the root
is reached.  Each byte is read once and no piece is built.

A word is read with a blank before it, as the vocabulary marks the beginning of
words.  Texts are split at the ASCII white space 0x09-0x0D and 0x20; UTF-8
bytes are matched, and a vocabulary with all single bytes matches every word.
A word that cannot be matched counts as one piece (``unknown``).

Defined results: a null or blank text has no words and no pieces; equal rows
give equal counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, utf8

STEP_WORDS = 200_000  # words that walk the automaton side by side
FEW = 16  # with so few words left, they go on one by one


@lru_cache(maxsize=2)
def byte_pieces(path: str) -> tuple[bytes, ...]:
    """Byte strings of a byte-level vocabulary file, special tokens left out.

    Such files write each byte as one visible character: printable Latin-1
    characters stand for themselves, the other bytes follow from U+0100 on.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {token["content"] for token in spec.get("added_tokens", ())}
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    return tuple(bytes(byte_of[c] for c in piece) for piece in spec["model"]["vocab"] if piece not in special)


class Automaton:
    """Trie with failure links.  ``child[node, byte]`` is 0 where there is none; node 0 is no node, 1 the root."""

    def __init__(self, pieces) -> None:
        nodes = {b"": 1}
        for piece in sorted(set(pieces) - {b""}):
            for end in range(1, len(piece) + 1):
                nodes.setdefault(piece[:end], len(nodes) + 1)
        strings = sorted(nodes, key=lambda s: (len(s), s))
        number = {s: i + 1 for i, s in enumerate(strings)}
        self.child = np.zeros((len(strings) + 1, 256), dtype=np.int32)
        self.fail = np.zeros(len(strings) + 1, dtype=np.int32)
        self.popped = np.zeros(len(strings) + 1, dtype=np.int32)
        is_piece = {number[p] for p in set(pieces) - {b""}}
        for s in strings[1:]:
            self.child[number[s[:-1]], s[-1]] = number[s]
        for s in strings[1:]:
            node, parent, byte = number[s], number[s[:-1]], s[-1]
            if node in is_piece:
                self.fail[node], self.popped[node] = 1, 1
                continue
            at, popped = int(self.fail[parent]), int(self.popped[parent])
            while at and not self.child[at, byte]:
                popped += int(self.popped[at])
                at = int(self.fail[at])
            if at:
                self.fail[node], self.popped[node] = self.child[at, byte], popped
        self.flat = self.child.reshape(-1)

    def count(self, word: bytes) -> int:
        """Pieces of one word; 1 if it has bytes that no piece continues."""
        return self._go_on(word, 0, 1, 0)

    def _go_on(self, word: bytes, start: int, node: int, popped: int) -> int:
        child, fail, pop = self.flat, self.fail, self.popped
        for byte in word[start:]:
            while not (below := child[node * 256 + byte]):
                popped += pop[node]
                if not (node := int(fail[node])):
                    return 1
            node = int(below)
        while node != 1:
            popped += pop[node]
            if not (node := int(fail[node])):
                return 1
        return int(popped)

    def count_all(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of many words given as ranges of one byte array; all words take their next byte at the same time."""
        found = np.zeros(len(starts), dtype=np.int64)
        node = np.ones(len(starts), dtype=np.int64)
        lost = np.zeros(len(starts), dtype=bool)
        live = np.argsort(starts - ends, kind="stable")  # longest first, so the live ones stay in front
        sizes = (ends - starts)[live]
        step, n = 0, int((sizes > 0).sum())
        while n > FEW:
            at = live[:n]
            byte = data[starts[at] + step].astype(np.int64)
            here = node[at]
            below = self.flat[here * 256 + byte]
            miss = np.flatnonzero(below == 0)
            while len(miss):
                back = here[miss]
                found[at[miss]] += self.popped[back]
                back = self.fail[back].astype(np.int64)
                gone = back == 0
                lost[at[miss[gone]]] = True
                here[miss] = np.where(gone, 1, back)
                below[miss] = np.where(gone, 1, self.flat[here[miss] * 256 + byte[miss]])
                miss = miss[below[miss] == 0]
            node[at] = below
            step += 1
            n = int(np.searchsorted(-sizes, -step))
        for w in live[:n]:
            found[w] = self._go_on(data[starts[w] : ends[w]].tobytes(), step, int(node[w]), int(found[w])) if not lost[w] else 1
            node[w] = 1
        left = np.flatnonzero((node != 1) & ~lost)
        while len(left):
            found[left] += self.popped[node[left]]
            node[left] = self.fail[node[left]]
            gone = left[node[left] == 0]
            lost[gone] = True
            left = left[node[left] > 1]
        found[lost] = 1
        return found


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs without ASCII white space."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(np.diff(np.r_[True, blank, True].astype(np.int8)))
    return edges[::2], edges[1::2]


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(byte_pieces(path))


def count_pieces(path: str):
    """Column function: UTF-8 bytes to ``struct<n_words, n_pieces>``."""

    @F.arrow_udf("n_words long, n_pieces long")
    def count(texts: pa.Array) -> pa.Array:
        machine = automaton(path)
        words, pieces = [], []

        def flush(part: list[bytes]) -> None:
            # every text ends with a blank, so the blank before a word belongs to no other word
            data = np.frombuffer(b" " + b" ".join(part) + b" ", dtype=np.uint8)
            starts, ends = word_ranges(data)
            bounds = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in part)]))
            blanked = np.where((data >= 9) & (data <= 13), np.uint8(32), data)
            counts = np.zeros(len(starts) + 1, dtype=np.int64)
            for i in range(0, len(starts), STEP_WORDS):
                counts[i + 1 : i + STEP_WORDS + 1] = machine.count_all(blanked, starts[i : i + STEP_WORDS] - 1, ends[i : i + STEP_WORDS])
            total = np.cumsum(counts)
            words.extend(np.diff(bounds).tolist())
            pieces.extend((total[bounds[1:]] - total[bounds[:-1]]).tolist())

        part, size = [], 0
        for text in texts:
            part.append(text.as_py() or b"")
            size += len(part[-1])
            if size > 2_000_000:
                flush(part)
                part, size = [], 0
        if part:
            flush(part)
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(pieces, pa.int64())], ["n_words", "n_pieces"])

    return count


def piece_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_pieces`` of whole texts."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), count_pieces(path)(utf8(text_col)).alias("n")).select("doc_id", "n.n_words", "n.n_pieces")
