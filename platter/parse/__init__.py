"""Readers and writers of disk structures."""
