"""Functions of lawmill."""
