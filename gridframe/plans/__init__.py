"""Chains of DataFrame steps described by data."""
