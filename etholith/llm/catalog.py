"""All queries of the operators and the pipeline."""

from etholith.llm import centroids, contexts, decontaminate, guesses, language, mixing, neighbours, pages, periodic, quality, simhash, substring, toolcalls  # noqa: F401
from etholith.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
