"""Sources: transcripts, glossaries, reference turns, scripts, audio files, and stand-ins over the driver's tables."""
