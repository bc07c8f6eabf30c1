"""Column functions: text measures and ranges, boolean text queries, timestamps."""
