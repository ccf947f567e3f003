"""Queries bound to the driver tables."""
