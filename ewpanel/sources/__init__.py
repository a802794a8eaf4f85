"""Readers of raw feeds and the roles of the driver tables."""
