"""The pipeline, stage by stage and as a whole, against plain Python on a small fixture."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

import corpus_pipeline
from arborframe.llm import decontamination, language_id, mixing, token_files

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs, found = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR).cache()
        found.append((docs, out))
        docs = out
    return found


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.schema == before.schema


def test_each_stage_decides(spark, stages):
    from test_llm_operators import plain_simhash

    (docs, named), (_, single), (_, clean), (_, mixed), (_, _) = stages
    found = language_id.identify(docs)
    assert ids(named) == ids(found.where("lang_pred <> 'und' AND score >= 0.5"))
    rows = named.orderBy("doc_id").collect()
    prints = np.array([plain_simhash(r["text"]) for r in rows], dtype=np.uint64)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 4):
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    assert ids(single) == sorted({rows[g]["doc_id"] for g in group})
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontamination.contaminated(single, bench).collect()}
    whole = {r["doc_id"] for r in single.collect() for b in bench.collect() if " ".join(b["text"].split()) in " ".join(r["text"].split())}
    assert whole <= hit
    assert ids(clean) == sorted(set(ids(single)) - hit)
    assert ids(mixed) == sorted({r["doc_id"] for r in mixing.select_tokens(clean, mixing.Plan(budget_permille=900, max_epochs=1)).collect()})


def test_run(spark, stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.tokenizer_file())
    found = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF_DIR).collect())
    start, expected = 0, []
    for r in stages[3][1].orderBy("doc_id").collect():
        row = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, token_files.END_ID]
        expected.append((r["doc_id"], start, len(row), zlib.crc32(np.array(row, dtype="<u4").tobytes())))
        start += len(row)
    assert found == expected
