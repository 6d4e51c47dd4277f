"""Live versions of the corpus operators on Structured Streaming."""
