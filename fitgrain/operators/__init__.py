"""Fit/transform table operators, evaluation queries and retrieval."""
