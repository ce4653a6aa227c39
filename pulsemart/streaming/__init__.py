"""Structured Streaming forms of the alert and dashboard aggregates."""
