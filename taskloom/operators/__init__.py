"""Relational operators of the reasoning-data flow."""
