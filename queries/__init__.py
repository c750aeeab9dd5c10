"""Registered queries: the operators run over the whole driver tables, with SQL to check them."""

from queries.registry import QUERIES, SQL
from queries import (  # noqa: F401  (fills the registry)
    anonymity, closeness, covers, federation, masks, perturbation, profiles, relations, rough, shapes, sources,
)

__all__ = ["QUERIES", "SQL"]
