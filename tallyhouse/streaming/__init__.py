"""Structured Streaming: silver and current state that follow bronze arrivals."""
