"""Readers with fixed schemas."""
