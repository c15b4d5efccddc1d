"""Registered queries of the corpus operators, with their production parameters, and their DuckDB SQL."""
from __future__ import annotations

import public_tokenizers

from tessera.llm.block_names import block_dedup
from tessera.llm.bpe import read_ranks, token_digests
from tessera.llm.chat import chat_format
from tessera.llm.common import table
from tessera.llm.decontaminate import edit_matches
from tessera.llm.dimension_scan import nearest_neighbours
from tessera.llm.divergence import divergences
from tessera.llm.jaccard import linked_components
from tessera.llm.license_scan import license_scan
from tessera.llm.line_chunks import line_dedup
from tessera.llm.neural_lm import lm_scores
from tessera.llm.oracles import SQL
from tessera.llm.quality import quality_scores
from tessera.llm.subvectors import clustered
from tessera.llm.warc import archive_pages, revisit_table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_chat_collapse(spark, sf_dir):
    return chat_format(table(spark, sf_dir, "conversations"))


def op2_jaccard_tiles(spark, sf_dir):
    return linked_components(table(spark, sf_dir, "documents"))


def op3_block_names(spark, sf_dir):
    return block_dedup(table(spark, sf_dir, "documents"))


def op4_edit_matches(spark, sf_dir):
    return edit_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_chunks(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark, sf_dir, ranks=RANKS):
    return token_digests(table(spark, sf_dir, "documents"), read_ranks(ranks))


def op9_warc_revisits(spark, sf_dir):
    return revisit_table(archive_pages(table(spark, sf_dir, "pages")))


def op10_neural_lm(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))


def op11_subvector_kmeans(spark, sf_dir):
    return clustered(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark, sf_dir):
    return divergences(table(spark, sf_dir, "documents"))


def op13_dimension_scan(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_chat_collapse, op2_jaccard_tiles, op3_block_names, op4_edit_matches, op5_quality, op6_line_chunks, op7_license_scan,
    op8_byte_bpe, op9_warc_revisits, op10_neural_lm, op11_subvector_kmeans, op12_source_divergence, op13_dimension_scan)}
