"""Structured Streaming forms of the batch operators (the reference itself has none)."""

from quarry.streaming.conform import conform_stream, violation_stream  # noqa: F401
