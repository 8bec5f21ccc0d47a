"""Measurement analytics on Spark."""
