"""Column functions and Python UDF surfaces."""
