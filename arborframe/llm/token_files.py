"""Operator 8: token ids as ORC files, and what can be read from them alone.

Each row of a file is one document: ``doc_id``, ``ids`` (its token ids and the
end id) and ``row``.  ORC stores the ids with integer run-length encoding in
independent stripes with min/max row indexes, and keeps a Bloom filter on
``doc_id``; a reader of some documents skips the stripes and row groups that
cannot hold them, a reader of all documents works stripe by stripe in parallel.

Rows are placed by range of ``doc_id`` and sorted, so the files are in ascending
id order.  ``row`` holds the number of the partition above bit 33 and the place
inside it below, hence it ascends over the whole set of files.

Defined results: a null text is empty and gives the end id alone; a null id
sorts first; rows with equal ids are ordered by text and all stay; an empty
table gives no rows; other columns are not stored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path

END_ID = 2
STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 1000
CACHE_WORDS = 600_000  # entries of a worker's word cache, both generations; no effect on results
JOINED_WORDS = 200  # new words that are encoded in one call
BATCH_CHARS = 4 << 20  # characters whose words are looked up together
MARKS = frozenset(punctuation)
BLANK = "Ġ"  # fixed value: the sign of a blank in byte-level vocabularies
LINE = "\x01"  # stands in front of a word that follows a line break in place of a blank

# Characters for which a blank before a non-blank always starts a new piece, and
# a blank between two white spaces that does not.
_BLANK_RUN = re.compile(r"\s (?:\s|\Z)")
_BEFORE_SPACE = re.compile(r" (?:\s|\Z)")  # found quickly; only then is the rest looked at
_SPACE = re.compile(r"\s")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")  # white space to one side only
# A line break with white space beside it, as it shows among words; elsewhere it is a piece of its own.
_ODD_LINE = re.compile(LINE + r"(?:\s|\Z)|[^\S ](?: |\Z)")
_LONE_LINE = re.compile(r"(?<=\S)\n(?=\S)")


class WordIds:
    """Packed token ids of words, found once per worker; ``before`` stands in front of each word.

    ASCII marks at the end of a word are a piece of their own if a letter or
    digit comes before them, so that words are kept without them. A full cache
    becomes the old generation, from which words that are met again move to the
    new one, so that frequent words are never forgotten.
    """

    def __init__(self, tokenizer, before: str, starts: np.ndarray | None) -> None:
        self.tokenizer, self.before, self.starts = tokenizer, before, starts
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def find(self, words: list[str]) -> list[bytes]:
        if self.starts is None:
            return self._find(words)
        stems, ends = words.copy(), {}
        for at in [at for at, word in enumerate(words) if word[-1:] in MARKS]:
            stem = words[at].rstrip(punctuation)
            if stem[-1:].isalnum():
                stems[at], ends[at] = stem, words[at][len(stem) :]
        if new := set(ends.values()).difference(self.marks):
            if len(self.marks) + len(new) > CACHE_WORDS // 10:
                self.marks, new = {}, set(ends.values())
            self.marks.update(self._encoded(list(new), ""))
        found = self._find(stems)
        for at, end in ends.items():
            found[at] += self.marks[end]
        return found

    def _find(self, words: list[str]) -> list[bytes]:
        found = list(map(self.young.get, words))
        if None in found:
            absent = [at for at, ids in enumerate(found) if ids is None]
            lacking = {words[at] for at in absent}
            known = {word: ids for word in lacking if (ids := self.old.get(word)) is not None}
            if len(self.young) + len(lacking) > CACHE_WORDS // 2:
                self.old, self.young = self.young, {}
            self.young.update(known)
            self.young.update(self._learn([word for word in lacking if word not in known]))
            for at in absent:
                found[at] = self.young[words[at]]
        return found

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        if self.starts is None:
            return self._encoded(words, self.before)
        if len(" ".join(words).split()) == len(words):  # no word is empty or holds white space
            known = self._joined(words)
        else:
            known = self._joined([word for word in words if word and not _SPACE.search(word)])
        if len(known) < len(words):
            known |= self._encoded([word for word in words if word not in known], self.before)
        return known

    def _encoded(self, words: list[str], before: str) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast([before + word for word in words], add_special_tokens=False)
        return {word: array("i", encoding.ids).tobytes() for word, encoding in zip(words, found, strict=True)}

    def _joined(self, words: list[str]) -> dict[str, bytes]:
        """Words without white space, encoded joined by ``before`` and cut where a token starts with it."""
        groups = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        known: dict[str, bytes] = {}
        for group, encoding in zip(groups, self.tokenizer.encode_batch_fast([self.before + self.before.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(encoding.ids, dtype=np.int32)
            cuts = [*(4 * np.flatnonzero(self.starts[ids])).tolist(), 4 * len(ids)]
            if len(cuts) == len(group) + 1 and cuts[0] == 0:
                packed = ids.tobytes()
                known.update(zip(group, [packed[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))
        return known


@lru_cache(maxsize=2)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if hasattr(tokenizer.model, "_resize_cache"):
        tokenizer.model._resize_cache(0)  # a word comes here once, so that its cache only costs time
    added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    vocabulary = tokenizer.get_vocab()
    starts = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
    for token, number in vocabulary.items():
        starts[number] = token.startswith(BLANK)
    line = tokenizer.encode("\n", add_special_tokens=False).ids
    lines = None
    if starts.any() and len(line) == 1 and not any("\n" in token or LINE in token for token in added):
        lines = WordIds(tokenizer, "\n", np.arange(len(starts)) == line[0])
    return tokenizer, added, WordIds(tokenizer, "", None), WordIds(tokenizer, " ", starts if starts.any() else None), lines


def _is_whole(text: str, added: list[str]) -> bool:
    """Whether a text must be encoded as a whole."""
    if _BEFORE_SPACE.search(text) and _BLANK_RUN.search(text):
        return True
    return any(token in text for token in added) or _SEPARATORS.search(text) is not None


def _is_odd(text: str, added: list[str]) -> bool:
    return bool(_BEFORE_SPACE.search(text) or _SEPARATORS.search(text) or any(token in text for token in added))


def _cut(text: str) -> str:
    """The text with a blank and ``LINE`` for every line break between words."""
    lines = text.split("\n")
    if len(lines) == 1:
        return text
    if any(not line or line[0].isspace() or line[-1].isspace() for line in lines):
        return _LONE_LINE.sub(" " + LINE, text)
    return (" " + LINE).join(lines)


def _find(later: WordIds, lines: WordIds | None, words: list[str]) -> list[bytes]:
    """Packed ids of words that follow a blank or a line break."""
    if lines is None:
        return later.find(words)
    at_lines = [at for at, word in enumerate(words) if word[:1] == LINE]
    of_lines = lines.find([words[at][1:] for at in at_lines])
    for at in at_lines:
        words[at] = ""  # found below, and not used
    packed = later.find(words)
    for at, ids in zip(at_lines, of_lines, strict=True):
        packed[at] = ids
    return packed


def _words(texts: list[str]) -> tuple[np.ndarray, pa.DictionaryArray, list[str]]:
    """Where each text's words start, all words by their number, and the first word of each text."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets, lists.values.dictionary_encode(), lists.values.take(pa.array(offsets[:-1])).to_pylist()


def encode_batch(path: str, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, each followed by ``end_id``, one after the other, and their numbers.

    The split before the merges never joins two words across a blank, unless
    the blank stands between white space; nor does it across a line break
    between two words.  So texts are cut at both, and each different word is
    looked up once per batch.  Texts with such blanks or with added tokens go to
    the tokenizer as they are.
    """
    if not texts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    tokenizer, added, first, later, lines = _load(path)
    whole = {at: text for at, text in enumerate(texts) if LINE in text} if lines else {}
    cut = texts if lines is None else ["" if at in whole else text.replace("\n", " " + LINE) for at, text in enumerate(texts)]
    offsets, words, heads = _words(cut)
    different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    joined = " " + " ".join(different)
    # Only a text with a word that is empty, starts with white space, or holds something odd can need the tokenizer as a whole.
    if _is_odd(joined, added) or (lines and _ODD_LINE.search(joined)):
        whole |= {at: text for at, text in enumerate(texts) if _is_whole(text, added)}
        offsets, words, heads = _words(["" if at in whole else text if lines is None else _cut(text) for at, text in enumerate(texts)])
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    codes = words.indices.to_numpy().astype(np.int64)
    packed = _find(later, lines, different)
    # A text's first word has no blank before it; a whole text stands in its place.
    codes[offsets[:-1]] = len(packed) + np.arange(len(texts))
    starts = first.find(heads)
    for at, text in whole.items():
        starts[at] = array("i", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    packed += starts
    if end_id is not None:
        codes = np.insert(codes, offsets[1:], len(packed))
        offsets = offsets + np.arange(len(offsets))
        packed.append(array("i", [end_id]).tobytes())
    table = np.frombuffer(b"".join(packed), dtype=np.int32)
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    places = np.cumsum(sizes) - sizes
    counts = sizes[codes]
    ends = np.cumsum(counts)
    ids = table[np.repeat(places[codes] - (ends - counts), counts) + np.arange(ends[-1])]
    totals = np.concatenate(([0], ends))[offsets]
    return ids, np.diff(totals)


def encode_texts(path: str, texts: list[str], end_id: int | None) -> list[np.ndarray]:
    """Ids of whole texts, each followed by ``end_id``."""
    ids, counts = encode_batch(path, texts, end_id)
    return np.split(ids, np.cumsum(counts)[:-1]) if texts else []


def _portions(texts: list[str]):
    """Slices of about ``BATCH_CHARS`` characters."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= BATCH_CHARS:
            yield texts[start : at + 1]
            start, size = at + 1, 0
    if start < len(texts):
        yield texts[start:]


def token_ids(path: str, end_id: int | None = END_ID):
    """Column function: text to ``array<int>``; a null text counts as empty."""

    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        parts = [encode_batch(path, part, end_id) for part in _portions([t or "" for t in text.to_pylist()])]
        offsets = np.concatenate([[0], *[counts for _, counts in parts]]).cumsum()
        values = np.concatenate([ids for ids, _ in parts]) if parts else np.zeros(0, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    return encode


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write them in ascending id order.

    The text is placed before it is encoded, since range placement samples its
    input and would otherwise encode it twice.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    placed = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = placed.select("doc_id", token_ids(tokenizer_path, end_id)("text").alias("ids"), F.monotonically_increasing_id().alias("row"))
    options = {
        "orc.bloom.filter.columns": "doc_id",
        "orc.stripe.size": str(STRIPE_BYTES),
        "orc.row.index.stride": str(ROW_INDEX_STRIDE),
        "compression": "lz4",
    }
    encoded.write.options(**options).orc(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, ids, row``; filters on ``doc_id`` prune stripes and row groups."""
    return spark.read.orc(folder)


def ids_crc32(column: str) -> Column:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("long")
    def crc(ids: pa.Array) -> pa.Array:
        offsets = ids.offsets.to_numpy()
        data = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        return pa.array([zlib.crc32(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64())

    return crc(column)


def token_index(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document.

    ``start`` is a prefix sum in two steps: inside each written partition, and
    over the totals of the partitions, one row each.
    """
    part = F.shiftright("row", 33)  # fixed layout of monotonically_increasing_id
    rows = files.select("doc_id", "row", part.alias("part"), F.size("ids").cast("long").alias("n_tokens"), ids_crc32("ids").alias("ids_crc32"))
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    offsets = totals.select(F.col("part").alias("__part"), before.alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    placed = rows.withColumn("inside", inside)
    joined = placed.join(offsets, placed["part"] == offsets["__part"])
    return joined.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_and_index(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the files into the shared folder and describe what they hold."""
    folder = scratch_path(spark, "token-files")
    write_token_files(docs, folder, tokenizer_file())
    return token_index(read_token_files(spark, folder))
