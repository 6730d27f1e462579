"""Parsers that turn a file into rows."""
