"""All registered queries."""

from foliate.plans import assembly, branches, classification, generation, ingest, lifecycle, nesting, operations, parsing, storage, validation, versioning  # noqa: F401
from foliate.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
