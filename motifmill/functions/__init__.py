"""functions of motifmill."""
