"""Panels from tables, and synthetic markets."""
