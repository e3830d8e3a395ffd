"""Exports: JSON and Markdown of meetings, display columns, the replay index."""
