"""Importing the query modules fills the registry."""

from framelark.plans import (  # noqa: F401
    queries_abx, queries_corpus, queries_frames, queries_models, queries_signals,
    queries_sources,
)
from framelark.plans.registry import ORACLES, QUERIES  # noqa: F401
