"""Streaming of the analytics library."""
