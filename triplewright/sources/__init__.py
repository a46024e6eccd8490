"""Readers of line-oriented graph files, and preflight checks."""
