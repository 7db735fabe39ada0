"""Operators on tables, arrays, images and observations."""
