"""skyquery: table queries, array expressions and observation selection, compiled to Spark."""
