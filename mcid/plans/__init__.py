"""Whole jobs made of several operators."""
