"""The pipeline operators' queries, each with production parameters over its whole table."""

from __future__ import annotations

from lumenfold.llm.bit_sliced_search import OP12_SQL, op12_bit_sliced_search
from lumenfold.llm.bm25_search import OP8_SQL, op8_bm25_search
from lumenfold.llm.byte_bpe import op11_byte_bpe
from lumenfold.llm.centroid_clustering import OP13_SQL, op13_ball_tree_clusters
from lumenfold.llm.chat_format import OP7_SQL, op7_chat_format
from lumenfold.llm.embedding_dedup import OP6_SQL, op6_embedding_dedup
from lumenfold.llm.mixing import op4_mix_sources
from lumenfold.llm.near_dedup import op1_near_dedup
from lumenfold.llm.packing import op3_best_fit_packing
from lumenfold.llm.pii import op9_pii
from lumenfold.llm.toxicity import op2_toxicity
from lumenfold.llm.url_filter import OP5_SQL, op5_url_filter
from lumenfold.llm.warc import OP10_SQL, op10_warc_round_trip

QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_mix_sources": op4_mix_sources,
    "op5_url_filter": op5_url_filter,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_bm25_search": op8_bm25_search,
    "op9_pii": op9_pii,
    "op10_warc_round_trip": op10_warc_round_trip,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_bit_sliced_search": op12_bit_sliced_search,
    "op13_ball_tree_clusters": op13_ball_tree_clusters,
}

#: DuckDB statements for the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op5_url_filter": OP5_SQL,
    "op6_embedding_dedup": OP6_SQL,
    "op7_chat_format": OP7_SQL,
    "op8_bm25_search": OP8_SQL,
    "op10_warc_round_trip": OP10_SQL,
    "op12_bit_sliced_search": OP12_SQL,
    "op13_ball_tree_clusters": OP13_SQL,
}
