"""Named queries over the given tables, with the SQL each one is checked against."""

from doclake.plans.catalog import inputs, replies, search, tables, texts
from doclake.plans.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
