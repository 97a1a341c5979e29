"""Reproducible shuffling, sampling and checking of training corpora on Spark."""
