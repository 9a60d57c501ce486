"""Volumes as tables."""
