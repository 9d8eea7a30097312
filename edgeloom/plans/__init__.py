"""The SQL front end: tokens, syntax trees, and their translation to DataFrames."""
