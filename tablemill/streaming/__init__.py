"""Streams: stateless operators take streaming frames as they are; table sinks run per micro-batch."""
