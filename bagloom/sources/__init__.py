"""Readers and writers of bags: ARFF files, table adapters, synthetic data."""
