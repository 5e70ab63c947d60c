"""Structured Streaming: event windows, audit totals, latest state."""
