"""All registered queries; importing the modules fills the registry."""
from gleaner.plans import (  # noqa: F401
    generation_queries,
    quality_queries,
    report_queries,
    retrieval_queries,
    text_queries,
)
from gleaner.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
