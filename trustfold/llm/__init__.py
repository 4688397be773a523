"""Operators for building language-model training corpora, and their queries."""
