"""Where series come from and where they are kept."""
