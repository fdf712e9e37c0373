"""Streaming of the media library."""
