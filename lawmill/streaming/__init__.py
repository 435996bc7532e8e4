"""Streaming of lawmill."""
