"""Structured Streaming forms of the keyed operators: an extension, the batch form is the definition."""
