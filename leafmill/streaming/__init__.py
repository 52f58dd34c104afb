"""Listening progress as a stream."""
