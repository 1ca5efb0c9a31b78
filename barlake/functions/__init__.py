"""Column functions: predicates, lookups and conversions."""

from .columns import *  # noqa: F403
