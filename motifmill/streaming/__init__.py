"""Micro-batch scoring with fitted models."""
