"""operators of motifmill."""
