"""Incremental and windowed maintenance of vector tables."""
