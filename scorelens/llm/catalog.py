"""All queries of this subpackage."""

from scorelens.llm import (  # noqa: F401
    bm25_wand_query,
    bpe_query,
    chat_events_query,
    disclosure_query,
    hilbert_shards_query,
    isolation_rules_query,
    ngram_join_query,
    prefix_trie_query,
    structure_repair_query,
    toxicity_gru_query,
    url_reputation_query,
    weak_quality_query,
    word_bpe_query,
)
from scorelens.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
