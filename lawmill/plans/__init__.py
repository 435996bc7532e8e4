"""Plans of lawmill."""
