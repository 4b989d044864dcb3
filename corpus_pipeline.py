"""The corpus pipeline: STAGES in order, and run() over ``documents``."""

from __future__ import annotations

from arborframe.llm import covering, decontamination, language_id, mixing, token_files
from arborframe.llm.common import ship, table
from arborframe.session import saved


def identify_language(spark, docs, sf_dir):
    """Documents whose language is found; the others go."""
    ship(spark)
    return language_id.keep_identified(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies."""
    ship(spark)
    return covering.drop_near_copies(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """Documents that the target weights select, once each."""
    return mixing.keep_selected(docs)


def write_tokens(spark, docs, sf_dir):
    """What the written token files hold."""
    ship(spark)
    return token_files.encode_and_index(spark, docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_tokens),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, each written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
