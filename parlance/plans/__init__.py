"""Plans: models behind interfaces, the meeting pipeline, and the registered queries."""
