"""All queries, gathered from the modules that define them."""

from __future__ import annotations

from ..functions import grounding, language, phrases, text  # noqa: F401
from ..operators import answering, context, curation, erasure, eventlog, federation, folding, lifecycle, retrieval, scans, segments, truth, vectors  # noqa: F401
from ..sources import foreign, leases, mirror  # noqa: F401
from ..streaming import projection, sweeps  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]


def FLAGSHIP(spark, sf_dir):
    """Hybrid retrieval: full text and vectors fused by reciprocal rank."""
    return retrieval.hybrid(spark, sf_dir, ["the", "of", "and"], 1, 40)
