"""Steps over pages, lines and books."""
