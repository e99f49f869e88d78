"""Import every query module so that it registers its queries."""

from dirwise.plans import q_changes, q_directory, q_feeds, q_link, q_quality, q_resolve, q_scalars, q_scoring  # noqa: F401
from dirwise.plans.registry import ORACLES, QUERIES  # noqa: F401
