"""Functions of the media library."""
