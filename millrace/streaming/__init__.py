"""Progress events as a stream."""
