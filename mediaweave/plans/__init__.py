"""Plans of the media library."""
