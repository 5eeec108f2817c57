"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from warder.llm import exact_dedup, importance, language, near_dedup, packing, pieces, quality, sharding, suffix_dedup, tool_calls, trie, warc, winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_hilbert_sharding": sharding.op1_hilbert_sharding,
        "op2_shortest_pack_first": packing.op2_shortest_pack_first,
        "op3_piece_encoding": pieces.op3_piece_encoding,
        "op4_winnowing": winnowing.op4_winnowing,
        "op5_order_minhash": near_dedup.op5_order_minhash,
        "op6_stream_dedup": exact_dedup.op6_stream_dedup,
        "op7_suffix_repeats": suffix_dedup.op7_suffix_repeats,
        "op8_tool_call_linking": tool_calls.op8_tool_call_linking,
        "op9_pairwise_quality": quality.op9_pairwise_quality,
        "op10_warc_round_trip": warc.op10_warc_round_trip,
        "op11_importance_resampling": importance.op11_importance_resampling,
        "op12_prefix_trie": trie.op12_prefix_trie,
        "op13_language_id": language.op13_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_stream_dedup": exact_dedup.OP6_SQL,
        "op8_tool_call_linking": tool_calls.OP8_SQL,
        "op10_warc_round_trip": warc.OP10_SQL,
        "op11_importance_resampling": importance.OP11_SQL,
        "op12_prefix_trie": trie.OP12_SQL,
    }
