"""Column builders: domain values, lexicons, text spans and turn scores."""
