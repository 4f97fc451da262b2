"""The stateless operators on Structured Streaming."""
