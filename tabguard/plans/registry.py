"""All registered queries and their oracle SQL."""

from tabguard.plans import (  # noqa: F401  each registers its own
    ensemble_queries,
    evaluation_queries,
    forensics_queries,
    prep_queries,
    shift_queries,
    spectral_queries,
    stream_queries,
    trust_queries,
    verdict_queries,
)
from tabguard.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
