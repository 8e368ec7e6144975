"""Streams: resumed processing by id, and windowed counts of late data."""
