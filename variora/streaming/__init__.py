"""Streaming extensions (the library's own; batch operators don't need them)."""
