"""Structured Streaming jobs over task events and notifications."""
