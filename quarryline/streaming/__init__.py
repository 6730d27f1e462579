"""Structured Streaming twins of the event reducers."""
