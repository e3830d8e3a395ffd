"""Streaming extensions: online pause segmentation, and windowed counts with late data."""
