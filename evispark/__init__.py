"""Bounded, deterministic evidence queries over record collections, on Spark."""
