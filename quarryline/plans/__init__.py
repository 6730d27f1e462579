"""Queries with SQL; importing the package registers all of them."""

from . import project, queries, retrieval  # noqa: F401
