"""Streams and progress."""
