"""Streams of samples into a store."""
