"""Operators for preparing language-model training corpora; nothing outside this folder imports it."""
