"""Operators over unbounded inputs by Structured Streaming."""
