"""Imports every query module, which fills the registry."""

from corpuscle.plans import corpus_queries, language_queries, ledger_queries, rerank_queries, scalar_queries, search_queries, store_queries  # noqa: F401
from corpuscle.plans.registry import ORACLES, QUERIES  # noqa: F401
