"""The analyses, one module per area; every function is DataFrame -> DataFrame."""
