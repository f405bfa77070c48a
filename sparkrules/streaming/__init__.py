"""Structured Streaming forms of windows, expiry and closing pairs."""
