"""Structured Streaming: event-time windows, stateful findings."""
