"""Cleaning plans: ordered step lists per kind of source."""
