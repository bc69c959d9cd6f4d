"""All named queries of the library, gathered from the plans."""

from tracewright.plans import alerts, attachments, catalogues, conversations, detections, entities, evaluation, footage, identities, intake, matching, presence, questions, relations, retrieval, sentiment, texts  # noqa: F401  they register their queries
from tracewright.registry import ORACLE_SQL, QUERIES
from tracewright.streaming import drains, jobs  # noqa: F401

__all__ = ["ORACLE_SQL", "QUERIES"]
