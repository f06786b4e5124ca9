"""streaming of motifmill."""
