"""Structured Streaming: fairness monitoring of a scored event stream."""
