"""Streams of page updates and decisions."""
