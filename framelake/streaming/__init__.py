"""Players as Structured Streaming state."""
