"""All named queries; importing a module registers its queries."""

from tablelens.plans import cleaning, findings, learning, profiles, tables, texts, timelines  # noqa: F401
from tablelens.plans.registry import CHECKS, QUERIES  # noqa: F401
