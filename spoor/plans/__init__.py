"""Every registered query, in a fixed order."""

from spoor.plans import queries_timeline, queries_history, queries_search, queries_images, queries_sources  # noqa: F401
from spoor.plans.registry import ORACLES, QUERIES  # noqa: F401
