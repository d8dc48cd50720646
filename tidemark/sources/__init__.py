"""Where series come from."""
