"""Continuous insertion in micro batches, and windows over event streams."""
