"""Corpus indexing, retrieval, graph and event analytics on Spark."""
