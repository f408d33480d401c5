"""Column-to-column functions: text, numbers, dates, arrays and JSON, geometry, taxonomy."""
