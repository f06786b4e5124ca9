"""sources of motifmill."""
