"""Building and querying an index."""
