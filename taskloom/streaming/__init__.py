"""Incremental corpus intake."""
