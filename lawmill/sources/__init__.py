"""Sources of lawmill."""
