"""Record schemas, readers and writers."""
