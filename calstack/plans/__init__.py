"""Programs of words, their stack, and its compilation to one DataFrame."""
