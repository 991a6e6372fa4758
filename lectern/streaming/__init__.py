"""Structured Streaming forms of the per-event stores."""
