"""Operators for preparing training text at scale; nothing else in motifmill imports this subpackage."""
