"""motifmill: Spark jobs that mine informative substrings and answer full-text questions over many samples."""
