"""Structured Streaming jobs over file events, uploads and search sessions."""
