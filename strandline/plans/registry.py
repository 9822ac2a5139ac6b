"""All queries of the engine's own operators, with their oracle SQL."""

from strandline.plans import curation, extra, groups, ledger, metrics, more, temporal  # noqa: F401  each module registers its queries
from strandline.plans.base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "m8_breakdown"
