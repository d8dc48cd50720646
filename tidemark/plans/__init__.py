"""Registered queries: each operator on series of the star schema, with its SQL."""
