"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from duonet.llm import bpe, chat_format, embedding_dedup, hmm_score, ngram_join, packing, quality_classifier, quality_rules, substring_dedup, url_filter

_MODULES = (url_filter, ngram_join, quality_classifier, embedding_dedup, hmm_score, quality_rules, bpe, substring_dedup, chat_format, packing)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
