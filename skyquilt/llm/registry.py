"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from skyquilt.llm import (  # noqa: F401
    contamination, importance, language_model, line_frequency, mixing, near_duplicates, quality, ranked_search, repeats, token_files, toxicity, url_filter, vantage,
)
from skyquilt.llm.queries import ORACLES, QUERIES  # noqa: F401
