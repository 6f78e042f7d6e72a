"""Structured Streaming: the tracking pipeline and live metrics."""
