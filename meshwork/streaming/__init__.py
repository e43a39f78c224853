"""Structured Streaming over the events table: windowed counts, sessions, running correlations."""
