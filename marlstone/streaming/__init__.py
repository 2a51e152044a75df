"""Streams and resumable state."""
