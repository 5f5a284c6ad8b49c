"""Experiment drivers and the registry of named queries."""
