"""Cleaning and analysis of paged text at scale, on Spark."""
