"""Queries of this package and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaymark.llm import bpe, chat, decontaminate, licenses, merkle, packing, prefix_trie, quality, simhash, token_frames, url_filter, warc_zip, wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_frames": token_frames.token_frames,
    "op2_url_filter": url_filter.url_verdicts,
    "op3_warc_zip": warc_zip.warc_records,
    "op4_decontaminate": decontaminate.benchmark_hits,
    "op5_simhash": simhash.simhash_components,
    "op6_chat": chat.chat_digests,
    "op7_packing": packing.packed_sequences,
    "op8_wrappers": wrappers.main_texts,
    "op9_licenses": licenses.license_scan,
    "op10_quality": quality.quality_rules,
    "op11_merkle": merkle.merkle_manifest,
    "op12_prefix_trie": prefix_trie.prefix_trie,
    "op13_bpe": bpe.bpe_round_trip,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc_zip": warc_zip.ORACLE,
    "op6_chat": chat.ORACLE,
    "op9_licenses": licenses.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
