"""Labels as a stream."""
