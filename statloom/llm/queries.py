"""Loads every query of this folder."""

from statloom.llm import exact_search, jaccard, merkle, neighbours, packing, secrets, sentence_spans, simhash, substrings, toxicity, transducer, whitening, wrappers  # noqa: F401
from statloom.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
