"""Image sources and sinks."""
