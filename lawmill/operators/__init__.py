"""Operators of lawmill."""
