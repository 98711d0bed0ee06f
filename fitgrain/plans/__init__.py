"""Ordered fit/transform plans: cleaning, features, training, scoring."""
