"""Extension: arrivals of files or events as a stream, merged into the index."""
