"""Readers, writers and canonical views."""
