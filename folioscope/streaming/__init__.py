"""Streaming extension: pages as they arrive."""
