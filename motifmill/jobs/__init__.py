"""Whole jobs: session settings and shipping of this package to the executors."""
