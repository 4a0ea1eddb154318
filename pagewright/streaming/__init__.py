"""Structured Streaming forms of the continuous behaviours."""
