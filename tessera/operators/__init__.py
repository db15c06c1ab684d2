"""Relational operators of general use."""
