"""Importing the query modules fills the registry."""

from framelark.llm import (  # noqa: F401
    queries_exact, queries_lines, queries_overlap, queries_quality, queries_sampling,
)
from framelark.llm.registry import ORACLES, QUERIES  # noqa: F401
