"""Every registered query of the library and the SQL that it is held against."""

from __future__ import annotations

from tessella.plans import analyses, passages, patterns, retrieval, sets, vectors  # noqa: F401
from tessella.plans.registry import QUERIES, SQL

FLAGSHIP = "topk_bm25"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
