"""Imports every query module of the subpackage, which fills the registry."""

from corpuscle.llm import query_duplicates, query_passages, query_prints, query_records, query_selection, query_text  # noqa: F401
from corpuscle.llm.registry import ORACLES, QUERIES  # noqa: F401
