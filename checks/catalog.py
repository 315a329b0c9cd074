"""All registered queries."""

from checks import columns, layout, model, plan, quality, scalars, space, written  # noqa: F401
from checks.registry import QUERIES

__all__ = ["QUERIES"]
