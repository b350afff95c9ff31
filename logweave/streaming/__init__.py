"""Structured Streaming: following a growing log."""
