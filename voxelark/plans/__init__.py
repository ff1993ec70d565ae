"""Queries over the test tables and whole applications."""

from .. import registry  # noqa: F401  all queries, in an order in which modules find each other
