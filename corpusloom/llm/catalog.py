"""All registered queries of this subpackage."""

from corpusloom.llm import byte_pairs, copies, divergence, filter_audit, fingerprints, near_duplicates, neighbours, packing, substrings, suffixes, token_counts, toxicity, urls  # noqa: F401
from corpusloom.llm.registry import ORACLES, QUERIES  # noqa: F401
