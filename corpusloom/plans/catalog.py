"""All registered queries."""

from corpusloom.plans import (  # noqa: F401
    catalog_blocks,
    catalog_files,
    catalog_graph,
    catalog_search,
    catalog_transcripts,
    catalog_web,
)
from corpusloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
