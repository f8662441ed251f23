"""Operators for preparing training text; nothing else in the library imports this."""

from tabforge.llm import collocations, decontaminate, hard_negatives, language, mixing, ngram_jaccard, pii, quality, substrings, token_binary, token_counts, url_filter, warc
from tabforge.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "collocations", "decontaminate", "hard_negatives", "language", "mixing", "ngram_jaccard", "pii", "quality", "substrings", "token_binary", "token_counts", "url_filter", "warc"]
