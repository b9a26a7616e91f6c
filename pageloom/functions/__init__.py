"""Columns of text, and scalar rules."""
