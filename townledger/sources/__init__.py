"""Landed files and stored pages to typed tables."""
