"""Operator 2: language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (1 to 3 characters, all
of the text, length-normalised).  The document frequencies cover every training
document; the weights are fitted on a bounded sample per language with
follow-the-regularised-leader, whose L1 penalty keeps most of them at zero
and whose L2 penalty bounds the rest.  Several shards of the sample are trained
side by side and their states are averaged after each round.  One temperature,
fitted on documents of the sample that are not trained on, turns the scores
into probabilities.

Defined results: a text that is null or has no letter is ``und`` with score 0;
documents without text or language teach nothing; without any training document
every prediction is ``und``; equal texts have equal predictions; ties go to the
language that sorts first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_fold

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BUCKET_BITS = 16


@dataclass(frozen=True)
class Settings:
    """``sample_per_language`` bounds the rows the weights are fitted on (in expectation; rows are chosen by hash of the id)."""

    sample_per_language: int = 1500
    calibration_share: float = 0.2
    shards: int = 8
    rounds: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray = field(repr=False)  # buckets x languages, idf not included
    bias: np.ndarray = field(repr=False)
    idf: np.ndarray = field(repr=False)
    temperature: float = 1.0


def _buckets(text: str) -> np.ndarray:
    """Hashed n-grams of the lower-cased text, one per place; other characters than letters count as one kind of gap."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where((codes < 97) | ((codes > 122) & (codes < 0xAA)), np.uint32(32), codes)
    codes = np.r_[np.uint32(32), codes, np.uint32(32)]
    grams, mixed = [], np.zeros(len(codes), dtype=np.uint32)
    for n in ORDERS:
        mixed = (mixed[: len(codes) - n + 1] * np.uint32(0x01000193)) ^ (codes[n - 1 :] * np.uint32(0x85EBCA6B))
        if n > 1:
            grams.append((mixed * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS))
        else:
            grams.append(((codes + np.uint32(7)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(grams).astype(np.int64)


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and length-normalised TF-IDF values of one text."""
    counts = np.bincount(_buckets(text), minlength=1 << BUCKET_BITS)
    where = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[where])) * idf[where]
    norm = np.sqrt(values @ values)
    return where, values / norm if norm else values


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _frequencies(batches):
    """Documents with each bucket, of one task."""
    size = 1 << BUCKET_BITS
    seen, n = np.zeros(size, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            mark = np.zeros(size, dtype=bool)
            mark[_buckets(text.as_py())] = True
            seen += mark
            n += 1
    if n:
        where = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, where]), pa.array(np.r_[n, seen[where]])], names=["bucket", "n"])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Per bucket the number of rows that have it, and the number of rows.  The result has a fixed size."""
    counted = texts.mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    total = 0
    for row in counted.collect():
        if row["bucket"] < 0:
            total = row["n"]
        else:
            found[row["bucket"]] = row["n"]
    return found, total


def _weights(z: np.ndarray, n: np.ndarray, s: Settings, penalised: bool = True) -> np.ndarray:
    l1, l2 = (s.l1, s.l2) if penalised else (0.0, 0.0)
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + l2))


def train_shard(rows: list[tuple[np.ndarray, np.ndarray, int]], state: tuple[np.ndarray, ...], s: Settings) -> tuple[np.ndarray, ...]:
    """One pass of follow-the-regularised-leader over the rows (buckets, values, class)."""
    z, n, zb, nb = (a.copy() for a in state)
    for where, values, label in rows:
        w, b = _weights(z[where], n[where], s), _weights(zb, nb, s, penalised=False)
        error = _softmax(values @ w + b)
        error[label] -= 1.0
        g = values[:, None] * error
        z[where] += g - (np.sqrt(n[where] + g * g) - np.sqrt(n[where])) / s.alpha * w
        n[where] += g * g
        zb += error - (np.sqrt(nb + error * error) - np.sqrt(nb)) / s.alpha * b
        nb += error * error
    return z, n, zb, nb


def fit(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows given that have text and language."""
    s = settings
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    seen, total = document_frequencies(rows.select("text"))
    idf = np.log((1 + total) / (1 + seen)) + 1.0
    # place of the id in [0, 1); a share of it is the sample, a part of that calibrates
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(s.shards)), 11) / F.lit(float(1 << 53))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, s.sample_per_language / sizes[lang]))])
    sample = rows.withColumn("place", place / share[F.col("lang")]).where("place < 1").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(s.shards)))
    code = {lang: i for i, lang in enumerate(languages)}
    calibrating = F.col("place") < s.calibration_share
    shape = (1 << BUCKET_BITS, len(languages))
    state = (np.zeros(shape), np.zeros(shape), np.zeros(shape[1]), np.zeros(shape[1]))
    spark = docs.sparkSession

    for _ in range(s.rounds):
        shared = spark.sparkContext.broadcast((idf, state))
        trained = sample.where(~calibrating).groupBy("shard").applyInPandas(_trainer(shared, code, s), "part binary")
        state = _average(state, [_unpack(r["part"]) for r in trained.collect()])
        shared.unpersist()
    z, n, zb, nb = state
    model = Model(languages, _weights(z, n, s), _weights(zb, nb, s, penalised=False), idf)
    held = sample.where(calibrating).select("lang", _scores(model)("text").alias("scores")).collect()
    if held:
        model.temperature = _temperature(np.array([r["scores"] for r in held]), np.array([code[r["lang"]] for r in held]))
    return model


def _trainer(shared, code: dict[str, int], s: Settings):
    """Task function: one pass over a shard in the order of its rows' hashes."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        idf, before = shared.value
        pdf = pdf.sort_values(["place", "doc_id", "text"])
        after = train_shard([(*vector(t, idf), code[lang]) for t, lang in zip(pdf.text, pdf.lang, strict=True)], before, s)
        moved = np.flatnonzero((after[1] != before[1]).any(axis=1))
        return pd.DataFrame({"part": [_pack(moved, after, len(pdf))]})

    return train


def _pack(moved: np.ndarray, state: tuple[np.ndarray, ...], rows: int) -> bytes:
    """The coordinates a shard has moved; its size is bounded by the number of buckets."""
    z, n, zb, nb = state
    head = np.array([len(moved), z.shape[1], rows], dtype="<i8")
    return b"".join([head.tobytes(), moved.astype("<i8").tobytes(), *(a.astype("<f8").tobytes() for a in (z[moved], n[moved], zb, nb))])


def _unpack(data: bytes) -> tuple[np.ndarray, tuple[np.ndarray, ...], int]:
    size, width, rows = np.frombuffer(data, "<i8", 3)
    moved = np.frombuffer(data, "<i8", size, 24)
    rest = np.frombuffer(data, "<f8", offset=24 + 8 * size)
    cut = size * width
    return moved, (rest[:cut].reshape(size, width), rest[cut : 2 * cut].reshape(size, width), rest[2 * cut : 2 * cut + width], rest[2 * cut + width :]), int(rows)


def _average(before: tuple[np.ndarray, ...], parts) -> tuple[np.ndarray, ...]:
    """Mean of the shards' states by their rows, in a fixed order."""
    parts = sorted(parts, key=lambda p: (p[2], p[0].tobytes()))
    total = sum(p[2] for p in parts)
    after = tuple(a.copy() for a in before)
    for moved, (z, n, zb, nb), rows in parts:
        share = rows / total
        after[0][moved] += share * (z - before[0][moved])
        after[1][moved] += share * (n - before[1][moved])
        after[2][:] += share * (zb - before[2])
        after[3][:] += share * (nb - before[3])
    return after


def _temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm.

    Labels are smoothed by one part in n + 2, else a separable sample would ask
    for certainty.
    """
    n, width = scores.shape
    target = np.full((n, width), 1 / (n + 2) / width)
    target[np.arange(n), labels] += 1 - 1 / (n + 2)
    loss = lambda t: -np.mean((target * np.log(_softmax(scores / np.exp(t)) + 1e-300)).sum(axis=1))
    low, high, ratio = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _scores(model: Model):
    @F.arrow_udf("array<double>")
    def scores(text: pa.Array) -> pa.Array:
        out = []
        for t in text:
            where, values = vector(t.as_py(), model.idf)
            out.append(values @ model.weights[where] + model.bias)
        return pa.array(out, pa.list_(pa.float64()))

    return scores


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Column ``struct<lang_pred, score>`` of whole texts; the model has a fixed size and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def of(text: pa.Array) -> pa.Array:
        m = shared.value
        names, scores = [], []
        for x in text:
            t = x.as_py()
            if not m.languages or not has_letter(t):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            where, values = vector(t, m.idf)
            p = _softmax((values @ m.weights[where] + m.bias) / m.temperature)
            best = int(p.argmax())
            names.append(m.languages[best])
            scores.append(float(p[best]))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return of(F.col(text_col))


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; documents whose crc32(id) mod 3 is 1 are held out."""
    held = in_fold("doc_id", 3, 1)
    model = fit(docs.where(~held), settings)
    found = docs.select("doc_id", held.alias("held_out"), predict(docs, model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, min_score: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """Documents whose language is found with at least this probability; rows and columns stay as they are."""
    model = fit(docs.where(~in_fold("doc_id", 3, 1)), settings)
    marked = docs.select(*[docs[c] for c in docs.columns], predict(docs, model).alias("__language"))
    kept = marked.where((F.col("__language.lang_pred") != UNKNOWN) & (F.col("__language.score") >= min_score))
    return kept.drop("__language")
