"""Text-provenance analytics as lazy Spark plans."""
