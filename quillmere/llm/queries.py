"""The llm operators' queries and their SQL, by name."""

from __future__ import annotations

from quillmere.llm import query_chat, query_decontaminate, query_html, query_jaccard, query_line_dedup, query_mixing, query_pii, query_quality, query_token_ids, query_warc

_MODULES = (query_chat, query_decontaminate, query_html, query_jaccard, query_line_dedup, query_mixing, query_pii, query_quality, query_token_ids, query_warc)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
