"""Registered queries ``opN_<name>`` and their oracle SQL."""

from __future__ import annotations

from tessera.llm import (block_search, decontaminate, html_text, jaccard, langid, licenses, near_vectors, packing, pfor, pii,
                         sharding, toxicity, whitening)
from tessera.llm.common import table


def op1_subsequence_extract(spark, sf_dir):
    """Main text of every page by the maximum-scoring subsequence."""
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op2_pfor_tokens(spark, sf_dir):
    """Ids of every document written as patched frame-of-reference blocks and read back."""
    return pfor.read_ids(pfor.write_ids(table(spark, sf_dir, "documents")), digest=True)


def op3_qgram_decontamination(spark, sf_dir):
    """Every document that holds a benchmark passage, with the item and the span."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_tiled_near_vectors(spark, sf_dir):
    """Embeddings of one label with cosine 0.98 or more: links, components and what stays."""
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_multiorder_jaccard(spark, sf_dir):
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more."""
    return jaccard.components(table(spark, sf_dir, "documents"))


def op6_stratified_shards(spark, sf_dir):
    """All documents in 16 shards that each hold the mixture of sources."""
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


def op7_differencing_packing(spark, sf_dir):
    """All documents packed into windows of 2048 ids by multiway differencing."""
    return packing.pack(table(spark, sf_dir, "documents"), digest=True)


def op8_weak_supervision_pii(spark, sf_dir):
    """Personal data of every document: the exact base and spans learned from labelers' votes."""
    return pii.find(table(spark, sf_dir, "documents"))


def op9_nnpu_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from toxic examples and unlabelled text."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_cnn_language(spark, sf_dir):
    """Language of every document by a byte convolutional network."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_block_whitening(spark, sf_dir):
    """Every embedding projected on the whitened principal components of the distinct vectors."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_blocked_search(spark, sf_dir):
    """The 20 best documents of every benchmark item."""
    return block_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_template_licenses(spark, sf_dir):
    """License wording of every document: phrases of the base and templates that match word for word."""
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_subsequence_extract": op1_subsequence_extract,
    "op2_pfor_tokens": op2_pfor_tokens,
    "op3_qgram_decontamination": op3_qgram_decontamination,
    "op4_tiled_near_vectors": op4_tiled_near_vectors,
    "op5_multiorder_jaccard": op5_multiorder_jaccard,
    "op6_stratified_shards": op6_stratified_shards,
    "op7_differencing_packing": op7_differencing_packing,
    "op8_weak_supervision_pii": op8_weak_supervision_pii,
    "op9_nnpu_toxicity": op9_nnpu_toxicity,
    "op10_byte_cnn_language": op10_byte_cnn_language,
    "op11_block_whitening": op11_block_whitening,
    "op12_blocked_search": op12_blocked_search,
    "op13_template_licenses": op13_template_licenses,
}

ORACLE = {
    "op4_tiled_near_vectors": near_vectors.NEAR_SQL,
    "op5_multiorder_jaccard": jaccard.COMPONENT_SQL,
    "op6_stratified_shards": sharding.SHARD_SQL,
    "op12_blocked_search": block_search.SEARCH_SQL,
}
