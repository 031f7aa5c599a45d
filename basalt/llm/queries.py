"""The queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basalt.llm.ann import op10_adaptive_dimension_scan
from basalt.llm.bitpack import op4_bit_packing
from basalt.llm.decontam import op5_suffix_automaton
from basalt.llm.html import op2_union_free_wrappers
from basalt.llm.packing import op6_shortest_pack_first
from basalt.llm.quality import op3_naive_bayes_support_vectors
from basalt.llm.secrets import op7_combined_automaton
from basalt.llm.simhash import op1_simhash_pigeonring
from basalt.llm.substring import op8_count_min_prefilter
from basalt.llm.warc import op9_merkle_fixity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_pigeonring,
        op2_union_free_wrappers,
        op3_naive_bayes_support_vectors,
        op4_bit_packing,
        op5_suffix_automaton,
        op6_shortest_pack_first,
        op7_combined_automaton,
        op8_count_min_prefilter,
        op9_merkle_fixity,
        op10_adaptive_dimension_scan,
    )
}

SQL: dict[str, str] = {
    "op9_merkle_fixity": """
        SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n_bytes, sha256(coalesce(html, '')) AS payload_sha256,
               CAST(2 AS INTEGER) AS n_replicas, CAST(0 AS INTEGER) AS n_damaged
        FROM pages
    """,
}
