"""Operators that prepare and score training corpora. Nothing else in the package imports this."""
