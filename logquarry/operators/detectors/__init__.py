"""Anomaly detectors and the registry that runs them."""
