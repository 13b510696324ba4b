"""Column functions: byte codecs, payloads, counter-based random numbers."""
