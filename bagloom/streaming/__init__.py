"""Assigning streams of new bags to a fitted model."""
