"""The searches with text once more, asked with whole benchmark passages: many and frequent terms."""

from __future__ import annotations

from functools import partial

from scholion.plans import activity, questions, search
from scholion.plans.base import REQUESTS, WHOLE_REQUESTS, Registry, whole_requests

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

NAMES = (
    "q7_keyword_rank", "q7_keyword_rank_tf", "q8_keyword_topk", "q8_stored_index", "q9_hybrid_rrf",
    "q10_enriched_hits", "q12_hits_with_neighbours", "q11_paging", "q13_page_metadata",
    "q15_document_keyword_topk", "q16_search_dispatch", "r1_context", "r2_citations", "r5_confidence",
    "r6_empty_fallback", "r7_rag_requests", "j11_append_history",
)

#: The filters and vectors are those of the two-word requests; only the text differs.
BOTH = REQUESTS.replace("requests AS", "two_words AS", 1) + ",\n" + WHOLE_REQUESTS

for family in (search, questions, activity):
    for name in NAMES:
        if name in family.QUERIES:
            sql = family.ORACLES[name].replace(REQUESTS, BOTH)
            R.add(f"{name}_whole_passages", sql)(partial(family.QUERIES[name], asking=whole_requests))
