"""Structured Streaming forms of the series statistics (extensions: there is no batch-only counterpart to match)."""
