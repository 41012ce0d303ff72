"""Readers: file listings, images, EXIF, run folders."""
