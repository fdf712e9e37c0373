"""Operators of the media library."""
