"""Panels that grow by new dates."""
