"""Fact types, ingestion and results."""
