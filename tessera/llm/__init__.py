"""Training-data pipeline operators.  Nothing outside this package imports it."""
