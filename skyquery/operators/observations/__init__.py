"""Observations: a main table and dimension tables that it refers to by row number."""
