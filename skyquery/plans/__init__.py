"""From query text to DataFrames: lexer, parser, compiler and statements."""
