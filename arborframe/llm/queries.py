"""The registered query of each operator: name to (query, SQL twin or None)."""

from __future__ import annotations

from . import covering, decontamination, hard_negatives, katz, language_id, license_scan, mixing, multi_index, multiset_hash, piece_counts, prefix_trie, token_files, warc
from .common import table

OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
g AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS first_id FROM g)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first_id THEN first_id END AS refers_to,
  greatest(1, CASE WHEN n >= 1000 AND page_id <> first_id THEN 1 ELSE CAST(ceil(n / 1048576.0) AS INTEGER) END) AS chunks
FROM m
"""


def op1_warc(spark, sf_dir):
    return warc.page_records(table(spark, sf_dir, "pages"))


def op2_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op3_mixing(spark, sf_dir):
    return mixing.select_tokens(table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_piece_counts(spark, sf_dir):
    return piece_counts.piece_counts(table(spark, sf_dir, "documents"), token_files.tokenizer_file())


def op6_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_katz(spark, sf_dir):
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op8_token_files(spark, sf_dir):
    return token_files.encode_and_index(spark, table(spark, sf_dir, "documents"))


def op9_covering_simhash(spark, sf_dir):
    return covering.simhash_components(table(spark, sf_dir, "documents"))


def op10_multiset_hash(spark, sf_dir):
    return multiset_hash.edited_table(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark, sf_dir):
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")), longest=None)


def op12_multi_index(spark, sf_dir):
    return multi_index.search(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_warc": (op1_warc, OP1_SQL),
    "op2_language_id": (op2_language_id, None),
    "op3_mixing": (op3_mixing, None),
    "op4_decontamination": (op4_decontamination, None),
    "op5_piece_counts": (op5_piece_counts, None),
    "op6_license_scan": (op6_license_scan, license_scan.SQL),
    "op7_katz": (op7_katz, None),
    "op8_token_files": (op8_token_files, None),
    "op9_covering_simhash": (op9_covering_simhash, None),
    "op10_multiset_hash": (op10_multiset_hash, None),
    "op11_hard_negatives": (op11_hard_negatives, hard_negatives.SQL),
    "op12_multi_index": (op12_multi_index, None),
    "op13_prefix_trie": (op13_prefix_trie, prefix_trie.SQL),
}
