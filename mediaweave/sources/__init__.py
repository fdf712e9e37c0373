"""Sources of the media library."""
