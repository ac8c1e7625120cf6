"""Fits, update steps, summaries and diagnostics of sparse Poisson factor models."""
