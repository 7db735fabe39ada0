"""Functions and aggregates of the query language, as builders of Columns."""
