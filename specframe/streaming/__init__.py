"""Structured Streaming form of the sliding-epoch operator."""
